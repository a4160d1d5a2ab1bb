"""The pipeline's stages against what each must do to its own input."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, columns = {}, docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, data)
        assert k == len(P.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
    n = [kept[name].count() for name, _ in P.STAGES]
    assert 200 > n[0] > 150 and n[0] > n[1] > n[2] == n[3]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    clean = [i for i, t in labels.items() if not t]
    stayed = {r["doc_id"] for r in kept["toxicity"].collect()}
    assert len(stayed.intersection(clean)) >= 0.97 * len(clean)
    texts = [r["text"] for r in kept["simhash_near_dedup"].collect()]
    assert len(texts) == len(set(texts))
    redacted = kept["pii_redaction"].collect()
    assert not any("@mail" in r["text"] for r in redacted) and all(r["n_chars"] == len(r["text"]) for r in redacted if "<" in r["text"])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in redacted)
    assert kept["packing"].selectExpr("sum(length) n").first()["n"] == want


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows(spark, data, empty):
    docs = spark.createDataFrame([(1, None, "en", None, None), (2, "", None, "s", 0), (None, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (4, "call +1 (555) 555-0100 " * 40, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.limit(0) if empty else docs
    for _, stage in P.STAGES:
        docs = stage(spark, docs, data).cache()
        docs.count()
    if not empty:
        assert sorted(r["doc_id"] for r in docs.select("doc_id").distinct().collect()) == [1, 3, 4]
    else:
        assert docs.count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark, data):
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, _leaked long, _gone long, _again long, _text string"
    rows = [(1, "one text of its own"), (2, "a second text here"), (2, "and a third one too"), (None, "a second text here"), (None, "and a third one too"), (None, "nobody else has this"), (7, "nobody else has this"), (7, "nobody else has this")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "r", 1, 2, 3, "t") for r in rows], columns)
    kept = P.drop_near_duplicates(spark, docs, data)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, rows[0][1]), (2, rows[1][1]), (2, rows[2][1]), (7, rows[5][1])]
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first()["text"]
    leak = spark.createDataFrame([(None, f"{item} and so on", "en", "s", 1, "r", 1, 2, 3, "t"), (2, f"see: {item}", "en", "s", 1, "r", 1, 2, 3, "t")], columns)
    more = docs.unionAll(leak)
    left = P.drop_leaks(spark, more, data)
    assert left.columns == docs.columns and sorted(r["text"] for r in left.collect()) == sorted(r[1] for r in rows)
    for stage in (P.drop_toxic, P.redact_personal_data):
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_packed_ids(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in P.pack(spark, docs, data).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)]))
    for r in docs.collect():
        assert [x for _, ids in sorted(got[r["doc_id"]]) for x in ids] == [*t.encode(r["text"], add_special_tokens=False).ids, 1]


def test_run_returns_the_last_stage(spark, data):
    assert {"doc_id", "sequence_id", "length"} <= set(P.run(spark, data).columns)
