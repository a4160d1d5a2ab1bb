"""Toxicity, HTML, decontamination and passages against brute force and planted cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyflow.llm import decontamination as D
from tallyflow.llm import html_text, passages, toxicity


PLAIN = {c: c + 32 for c in range(65, 91)} | {c: 32 for c in range(9, 14)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_plain_distances():
    rng = random.Random(7)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 11))): rng.random() < 0.2 for _ in range(40)}
    trie = toxicity.FuzzyTrie(terms)
    for _ in range(4000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12)))
        best = None
        for t, stem in terms.items():
            d = 0 if stem and word.startswith(t) else None if stem and distance(word, t) else distance(word, t)
            if d is not None and d <= toxicity.bounds(t, stem) and (best is None or (d, -len(t), t) < best):
                best = (d, -len(t), t)
        assert trie.match(word) == (best and (best[2], best[0])), (word, best)


def test_quotation_is_told_from_abuse():
    model = toxicity.Model({"idiot": (False, 5.0), "worthless": (False, 5.0)})
    find = toxicity.matcher(model)
    f = lambda t: toxicity.features(pa.array([t]), find, model)[0]
    assert f("you are an idiot")[0] > 0 and f("you are an idiot")[3] == 0
    assert f('he heard "you idiot" there')[3] > 0 and f("the word idiot is old")[3] > 0
    assert f("so worthles you are")[2] > 0 and f("an IDIOT!")[0] > 0 and f("")[5] == 0
    assert f("you id1ot")[2] > 0 and f("you i*diot!")[2] > 0 and f("w-orthl3ss")[2] > 0 and not f("1234 %%% a1b2").any()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    more = docs.withColumn("score", docs["lang"])
    out = toxicity.score(more, toxicity.fit(more, labels)).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").selectExpr("avg(int(predicted = toxic)) a", "avg(if(toxic = 0, predicted, null)) fp", "min(score) lo", "max(score) hi").first()
    assert out["a"] > 0.94 and out["fp"] < 0.02 and 0 <= out["lo"] <= out["hi"] <= 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, ""), (1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id long, toxic int")):
        out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(out) == 4 and all(r["predicted"] == 0 for r in out)


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<p>Hello <a href=x>big</a>  <b>wor</b>ld &eacute;&#33;<br>next</p>", "Hello big world é! next"),
    ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>One.</p><div class='ad'>Buy</div><p>Two.</p><form>f</form></article><div id=comments><p>me too</p></div><footer>&copy;</footer></body>", "T\nOne.\nTwo."),
    ("<article><p>x</p><script>var a = '</p><p>no';</script><!-- <p>no</p> --><style>p{}</style><p>y</p></article>", "x\ny"), ("<main><header><h1>Title</h1></header><p>Text</p></main><header>Site</header>", "Title\nText"),
    ("<div class='cookie-notice'>ok?</div><div class=post><p>A long enough paragraph of the article itself, with words.</p><p>Short.</p></div><aside>s</aside>", "A long enough paragraph of the article itself, with words.\nShort."),
    ("<article><p>a<b>b<p>c</i></article></div>", "ab\nc"), ("<article><ul><li>1<li>2</ul><table><tr><td>x<td>y</table></article>", "1\n2\nx\ny"), ("<p>unclosed <a href='", "unclosed <a href='"), ("<article>t &notanentity; &lt;b&gt; &am</article>", "t ¬anentity; <b> &am"),
])
def test_main_text(page, want):
    assert html_text.main_text(page or "") == want


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='layout-no-comments site-no-ads'", "div class='content-sidebar'", "div id=page class='with-sidebar wide'", "form method=post action='./page.aspx'"])
def test_wrappers_of_the_page_are_no_noise(wrapper):
    text = "A long enough paragraph of the article itself, with words."
    around = "<body><nav><a href=/>Home</a></nav><%s>%s<div class='sidebar'><p>Other things.</p></div><form><p>Your name</p></form><div class=post-comments><p>me too</p></div></%s><footer>f</footer></body>"
    for inner in (f"<div class=post><p>{text}</p><p>{text}</p></div>", f"<article><p>{text}</p><p>{text}</p></article>"):
        assert html_text.main_text(around % (wrapper, inner, wrapper.split()[0])) == f"{text}\n{text}"


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 and "<p>" not in r["text"] and "©" not in r["text"] for r in rows.values())
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x", "t"), (1, "u", "<" * 5000, "t"), (2, "u", "<div>" * 3000 + "deep", "t")], "page_id long, url string, html string, text string")
    assert sorted((r["text"][:4], r["n_chars"]) for r in html_text.extract(odd).collect()) == [("", 0), ("<<<<", 5000), ("deep", 4), ("x", 1)]


def test_deep_pages_are_read_in_one_pass():
    import time

    began = time.process_time()
    for open_tag, tag in (("<a href=x>", "b"), ("<p><table><tr><td>", "i"), ("<ul><li>", "span")):
        page = "<div>" + open_tag + "".join(f"<{tag}>w " for _ in range(16_000)) + "<div>end</div></div>"
        assert html_text.main_text(page).replace("\n", " ").endswith("w end")
    assert time.process_time() - began < 6


ITEM = "If Tom buys 12 apples for 3 dollars each and gives Tom 4 kg of pears, how much does Anna pay?"


def leaked(spark, *texts, items=(ITEM,)):
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, item_id string, hash int")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in D.leaks(d, b).collect()}


def test_templates_and_slots(spark, monkeypatch):
    texts = [
        "Intro here. If Mary buys 15 apples for 7 euros each and gives Mary 9 kg of pears, how much does Bob pay? End.", "If Mary buys 15 apples for 7 euros each and gives Zoe 9 kg of pears, how much does Bob pay?",
        ITEM.upper(), "x " * 500 + ITEM + " y" * 500, None, "", "If Tom buys apples", ITEM[:30], "something else entirely, with Tom and 12 apples for Anna and 3 dollars",
    ]
    assert leaked(spark, *texts) == {(0, 0), (2, 0), (3, 0)}
    monkeypatch.setattr(D, "MOST_KNOWN", 0)
    assert leaked(spark, *texts, items=(ITEM, None, "", "four words are few")) == {(0, 0), (2, 0), (3, 0)}
    assert leaked(spark, *texts, items=()) == set()


def test_names_that_begin_sentences(spark):
    items = ("Tom has 12 apples and gives 3 to Anna. Mary buys 5 kg of pears each week. How much does Tom pay?", "James runs 3 sprints a day. Anna runs 5 miles a day. Tom runs 7 miles a week. Who runs most?")
    texts = ["Bob has 15 apples and gives 4 to Zoe. Lucy buys 7 kg of pears each week. How much does Bob pay?", "Well: Peter runs 4 sprints a day. Lucy runs 6 miles a day. Bob runs 9 miles a week. Who runs most?", "Bob has 15 apples and gives 4 to Zoe. Peter runs far."]
    assert leaked(spark, *texts, items=items) == {(0, 0), (1, 1)}


def test_numbers_in_two_roles_and_dense_items(spark):
    items = ("Each of the pupils buys 3 pens for 3 dollars and then walks home", "Add 3, 4, 5, 6 and 7", "please add 3, 4, 5, 6, 7, 8 and 9 then add 1, 2, 3 and 4 to what you have found")
    texts = ["Each of the pupils buys 5 pens for 8 dollars and then walks home", "Add 1, 9, 2, 8 and 11", "please add 13, 14, 15, 16, 17, 18 and 19 then add 2, 4, 6 and 8 to what you have found", "1 2 3 4 5 6 7 8 and 9 or 10"]
    assert leaked(spark, *texts, items=items) == {(0, 0), (1, 1), (2, 2)}


def test_leaks_against_brute_force(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    grams = lambda t: {tuple(w[i : i + 8]) for w in [t.lower().split()] for i in range(len(w) - 7)}
    b = {r["item_id"]: grams(r["text"]) for r in items.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, g in b.items() if len(grams(r["text"]) & g) >= 0.6 * len(g) > 0}
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, items).collect()} == want


def test_compact_windows_hold_every_passage():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 90):
        h = rng.integers(0, 30, n).astype(np.uint64)
        for least in (1, 4, 10):
            found = {}
            for left, c, right in passages.compact_windows(h, least):
                for i in range(left, c + 1):
                    for j in range(c, right + 1):
                        assert (i, j) not in found
                        found[i, j] = c
            for i in range(n):
                for j in range(i + least - 1, n):
                    assert found[i, j] == i + int(h[i : j + 1].argmin())


def test_shared_passages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for r in docs.collect():
        w = r["text"].translate(PLAIN).split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(r["doc_id"])
    want = set().union(*(s for s in seen.values() if len(s) > 1))
    rows = passages.near_passages(docs).collect()
    assert want <= {i for r in rows for i in (r["doc_id"], r["other_id"])}
    text = {r["doc_id"]: r["text"].translate(PLAIN).split() for r in docs.collect()}
    for r in rows:
        a, b = text[r["doc_id"]][r["start"] : r["stop"]], text[r["other_id"]][r["other_start"] : r["other_stop"]]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        assert min(len(a), len(b)) >= 50 and abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8 and r["doc_id"] > r["other_id"]


def test_planted_passages(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    some = lambda n: [word() for _ in range(n)]
    p, q = some(60), some(120)
    near = [w if k % 40 else word() for k, w in enumerate(q)]
    texts = [some(80) + p + some(80), p + some(30), some(200) + p, some(90) + q, some(20) + near + some(50), some(300), some(49), None, "", "a " * 400]
    df = spark.createDataFrame([(k, " ".join(t) if isinstance(t, list) else t, 5) for k, t in enumerate(texts)] + [(None, " ".join(p), 1), (5, " ".join(texts[5]), 1)], "doc_id long, text string, key int")
    rows = passages.near_passages(df).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(1, 0), (2, 0), (4, 3)}
    assert {(r["doc_id"], r["start"], r["stop"], r["other_start"]) for r in rows if r["other_id"] == 0} == {(1, 0, 60, 80), (2, 200, 260, 80)}
    assert passages.near_passages(df.limit(0)).count() == 0


def test_passage_whose_least_shingles_an_earlier_document_holds(spark):
    rng = random.Random(5)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    p = some(50)
    s, _ = passages.shingles(pa.array([" ".join(p)]))
    seeds = passages._mixed(np.arange(1, passages.HASHES + 1, dtype=np.uint64) * np.uint64(passages._MIX[0] >> 1))
    least = sorted({int(passages._mixed(s ^ k).argmin()) for k in seeds})
    phrases = [w for c in least for w in ["zz"] * 60 + p[c : c + passages.SHINGLE] + ["zz"] * 60]
    texts = [phrases, some(80) + p + some(80), some(30) + p + some(90)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {(r["doc_id"], r["start"], r["stop"], r["other_id"], r["other_start"]) for r in passages.near_passages(df).collect()} == {(2, 30, 80, 1, 80)}
