"""A corpus pipeline over ``documents``: toxicity, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. ``run``
writes each stage's result as Parquet and reads it as the next one's docs, so no stage computes an earlier one again, and
a lost executor costs the tasks that it ran.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import decontamination, packing, pii, simhash, toxicity
from tallyflow.llm.common import shared_folder, small_side, table


def keyed(docs: DataFrame) -> DataFrame:
    """(row, text): each row as one value, so that an operator's result holds it whole; no column can clash with others."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model scores below 0.5, each judged by its own text; a null text is empty, and stays."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(keyed(docs), model, key="row").where("predicted = 0").select("doc_id.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest id."""
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark, each judged by its own text; ids may repeat or be null."""
    row = F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("text"))
    found = decontamination.leaks(docs.select(row.alias("row"), docs["text"]), table(spark, sf_dir, "benchmark"), key="row")
    leaked = small_side(found.select("doc_id").distinct())
    return docs.join(leaked, row.eqNullSafe(leaked["doc_id"]), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each span of personal data replaced by its kind; n_chars counts what is left where one was."""
    done = pii.redact(keyed(docs), key="row")
    left = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    changed = {"text": F.col("redacted"), "n_chars": F.when(F.size("spans") > 0, left).otherwise(F.col("doc_id.n_chars"))}
    return done.select(*[changed.get(c, F.col("doc_id").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths of at most 2048 tokens, with their ids (4 little-endian bytes each); a null text is empty."""
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("pii_redaction", redact_personal_data),
    ("packing", pack),
]
#: SQL has no fingerprints by XXH64, no learned model and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage results go below the shared folder of ``spark.checkpoint.dir``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
