"""The operators that judge each row on its own, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyflow.llm import common, packing, pii, quality, sharding, tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\n", "a", "a b", "a b a b a b", "x\ny\nx\n \n \nx", "one two three one two three four", "# * $ %", "é è ê\x1c\x85f", "İSTANBUL ΣΑΣ ﬁ é ｆ",
    "don't I'LL we've '' 's 'sun <|endoftext|> a<|startoftext|>b <|endoftext|", "X<|ENDOFTEXT|>y <|EndOfText|> J̌ Ǆ", "1234567 12a34 ½ ² ٣", "日本語 テキスト 👍🏽 a​b", "w " * 3000, "wörter " * 50 + "! " * 60, "a" * 5000,
    "mail a.b@c.d_e@f.gh, x@y, z@q.r. +1 (555) 555-0100 10.0.0.1 1.2.3.4.5 300.1.1.1 007.0.0.1", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111 1 2 3", "😀 a@b.co 😀 +49 30 1234567",
    "a@b@c.de +12 +1234567890123456 +1-23-45-67-89-0.", "IBAN DE89 3704 0044 0532 0130 00, account GB82WEST12345698765432 DE89370400440532013001", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 04dbebab91ab85687d33eeaaf9ac699e1188f962',
    "1 " * 400 + "9.9.9.9 " * 600, "12345678901234567890123 " * 3, "A" * 40 + "@", "@@..@ a@ @b.c",
]


@pytest.fixture(scope="module")
def docs(spark, data):
    odd = spark.createDataFrame([(i // 2, t, "w", "fail_bits") for i, t in enumerate([*ODD, *ODD])], "doc_id long, text string, words string, fail_bits string")
    return odd, spark.read.parquet(f"{data}/documents.parquet"), odd.limit(0)


def each(docs):
    for df in docs:
        yield df, [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_sharding(spark, docs):
    for df, rows in each(docs):
        got = sharding.shard(df, [1.0] * 16, [1.0] * 17).collect()
        assert Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
        slots = {}
        for r in got:
            assert r["grown_shard"] in (r["shard"], 16)
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weighted_shards_and_removal(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'' text")
    a = {r["doc_id"]: r["shard"] for r in sharding.shard(ids, [1.0, 2.0, 1.0]).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard(ids, [1.0, 2.0, 0.0]).collect()}
    n = Counter(a.values())
    assert abs(n[1] - 10000) < 300 and abs(n[0] - 5000) < 300
    assert all(b[k] == s for k, s in a.items() if s != 2) and 2 not in b.values()
    hot = spark.range(1000).selectExpr("cast(null as long) doc_id", "'x' text")
    assert sorted(r["slot"] for r in sharding.shard(hot, [1.0] * 4).collect()) == list(range(1000))


def brute_quality(t):
    w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs):
    for df, rows in each(docs):
        got = quality.apply_policy(quality.ledger(df), "v1").collect()
        assert Counter((i, *brute_quality(t)) for i, t in rows) == Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
        assert all(not (r["fail_bits"] & quality.BIT["too_few_words"]) == (r["n_words"] >= 50) for r in got)


def test_ablation(spark, docs):
    rows = quality.ledger(docs[1])
    bits = [r["fail_bits"] & quality.mask("v1") for r in rows.collect()]
    for r in quality.ablate(rows, "v1").collect():
        bit = quality.BIT[r["rule"]]
        assert (r["failed"], r["failed_alone"], r["kept_without"]) == (sum(bool(b & bit) for b in bits), bits.count(bit), sum(not b & ~bit for b in bits))


def test_clean_documents_are_kept(spark, data):
    rows = quality.apply_policy(quality.ledger(spark.read.parquet(f"{data}/documents.parquet")), "v1").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    good = rows.where("quality = 1 and n_words >= 50").selectExpr("avg(int(kept)) k").first()["k"]
    assert good > 0.9


def test_token_counts(spark, docs):
    t = Tokenizer.from_file(VOCABULARY)
    for df, rows in each(docs):
        got = tokens.count_tokens(df, VOCABULARY).collect()
        want = Counter((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x in rows)
        assert want == Counter(map(tuple, got))


def test_packing(spark, docs):
    t = Tokenizer.from_file(VOCABULARY)
    for df, rows in each(docs):
        got = packing.pack(df, VOCABULARY).collect()
        want = Counter()
        for i, x in rows:
            ids, at = [*t.encode(x, add_special_tokens=False).ids, 1], 0
            for n in packing.piece_lengths(len(ids), 2048):
                want[i, at, n, np.array(ids[at : at + n], "<u4").tobytes(), len(ids), n.bit_length() - 1] += 1
                at += n
            assert at == len(ids)
        assert want == Counter((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"], r["bucket"]) for r in got)
        assert len({r["sequence_id"] for r in got}) == len(got)
        assert {(r["ids_crc32"], r["offset"]) for r in packing.digest(packing.pack(df, VOCABULARY)).collect()} == {(zlib.crc32(x[3]), 0) for x in want}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m.group()))


def test_pii(spark, docs):
    for df, rows in each(docs):
        got = pii.find(df).selectExpr("doc_id", "spans", f"{pii.listed(kinds=pii.BASE)} base").collect()
        name = [k.name for k in pii.KINDS]
        want = Counter((i, ",".join(f"{name[k]}:{a}:{b}" for a, k, b in brute_pii(t))) for i, t in rows)
        assert want == Counter((r["doc_id"], r["base"]) for r in got)


def test_added_kinds_and_redaction(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013001; token 04dbebab91ab85687d33eeaaf9ac699e1188f962 and 14dbebab91ab85687d33eeaaf9ac699e1188f962x"
    one = spark.createDataFrame([(1, text), (2, None), (3, "😀 a@b.co, +1 (555) 555-0100"), (4, "plain"), (5, "a@b.co " * 700), (6, "x 4111 1111 1111 1111.1.1.1 y")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.redact(one).selectExpr("doc_id", f"{pii.listed()} s", "redacted", "spans").collect()}
    at = text.index("04db")
    assert got[1]["s"] == f"iban:5:32,secret:{at}:{at + 40}" and got[1]["redacted"].startswith("IBAN <IBAN> or DE89")
    assert got[2]["redacted"] is None and got[3]["redacted"] == "😀 <EMAIL>, <PHONE>" and got[4]["redacted"] == "plain" and got[5]["redacted"] == "<EMAIL> " * 700
    assert got[6]["s"] == "card:2:21" and got[6]["redacted"] == "x <CARD>.1.1.1 y"


def test_operators_need_no_order_of_columns(spark):
    df = spark.createDataFrame([("t1", 5)], "body string, id long")
    assert tokens.count_tokens(df, VOCABULARY, key="id", text="body").first()["doc_id"] == 5


def test_lines_of_form_feeds_and_of_the_letter_f(spark):
    texts = ["f\nff\nf\nx", "\f\n\f\n\f\r\nx\nx", "a\fb\n\x0b\n\t \f"]
    got = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    lines = [[x for x in t.split("\n") if WORDS.search(x)] for t in texts]
    assert [(r["n_lines"], r["n_dup_lines"]) for r in got] == [(len(x), len(x) - len(set(x))) for x in lines] == [(4, 1), (2, 1), (1, 0)]


def test_packing_spells_a_word_once_whatever_its_case_and_marks():
    ids, asked = packing.TextIds(VOCABULARY), []
    spell = ids.word
    ids.word = lambda w: asked.append(w) or spell(w)
    texts = pa.array(["Abc abc, ABC. abc., é. 3,", "", "don't.,"])
    found, bounds = ids(texts, b"\1\0\0\0")
    assert sorted(asked) == sorted(["abc", ",", ".", ".,"])
    library = Tokenizer.from_file(VOCABULARY)
    assert [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts.to_pylist()]


def test_a_worker_keeps_one_operator():
    first = common.kept(("a",), dict)
    assert common.kept(("a",), dict) is first
    common.kept(("b",), dict)
    assert list(common._kept) == [("b",)]
    common.forget()
    assert not common._kept
