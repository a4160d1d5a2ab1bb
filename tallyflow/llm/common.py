"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions.stages import shared_folder, stored  # noqa: F401

T = TypeVar("T")

#: A word is a run of anything but space and the ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of text that an operator in Python takes up at once. A batch of long texts is cut, so memory follows this and the longest text.
SLICE = 1 << 21


#: Bytes of a batch that goes to Python where rows hold long lists.
BATCH = 1 << 22


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH) -> Iterator[None]:
    """Actions inside send Python batches of about ``most`` bytes, or of one row. A batch lies outside an executor's heap, by Spark's
    defaults up to 64 MB of it for each task, twice while its buffers grow, and once more in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def strings(column) -> Iterator[str]:
    """An Arrow column's values one after the other, so that a batch's texts aren't all Python objects at once."""
    return (x.as_py() for x in column)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows whose texts in ``column`` have ``most`` bytes or are one text. No empty ones."""
    for b in batches:
        ends, at = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def dictionary(pieces: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``coded`` with the distinct pieces left in Arrow."""
    found = pieces.flatten().dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return found.dictionary, found.indices.to_numpy(), starts


def coded(pieces: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct, codes, starts) of a slice's texts cut into pieces: piece i is ``distinct[codes[i]]``, text k's are those
    from ``starts[k]`` to ``starts[k + 1]``.

    What a piece stands for is so worked out once a slice, and gathered by integers; no piece in the text is a Python object.
    """
    distinct, codes, starts = dictionary(pieces)
    return distinct.to_numpy(zero_copy_only=False).tolist(), codes, starts


_kept: dict[tuple, object] = {}


def kept(name: tuple, make: Callable[[], T]) -> T:
    """What an operator remembers in a Python worker from task to task. Workers outlive a query, so the one of another operator
    goes first, else each stage's caches would stay beside the next one's."""
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Lets go of what another operator left in this worker."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers that share this machine's folders import the package from where it lies."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    if here not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Files of shuffles and checkpoints stay until the driver's objects for them are collected; loops of many steps ask for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A narrow side of a join, stored and counted: it is broadcast if it has at most ``most`` rows, else shuffled."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of (a, b): a row (node, component) for each node but the smallest of
    its component, which stands for itself.

    ``component`` is the smallest node that can be reached.  Each round hangs every neighbour of a node under the
    smallest node in sight: first from the larger ends (large star), then from the smaller ones (small star).
    Both are group-bys whose minima combine before the shuffle, so a node with very many neighbours sends one
    row from each task; what is hung anew is an equi-join that adaptive execution can split.  Rounds go on until no
    edge changes, which takes about log2 of the longest path; not to be done by then is an error, never a cut result.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for k in range(rounds):
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (row["n"], row["h"]):
            del both, low, large, least, small, row
            let_go(edges.sparkSession)
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        before = (row["n"], row["h"])
        if k % 2:  # each round's shuffles leave files of all tasks, however few the edges
            del both, low, large, least, small
            let_go(edges.sparkSession)
    raise RuntimeError(f"components were still changing after {rounds} rounds")


def numbered(df: DataFrame, group: list[str], keys: list[str], salts: int, name: str) -> DataFrame:
    """Adds the long ``name``: 0, 1, 2... without gaps inside each ``group``, whose number of values must be small.

    No task sees a whole group: its rows are dealt to ``salts`` buckets by the hash of ``keys``, equal rows are counted
    before they are shuffled, each bucket is numbered on its own and starts where the bucket before it ends.  The table
    of starts has ``salts`` rows per group, whatever the number of rows; it alone is broadcast.  Rows that are equal in
    ``group`` and ``keys`` get different numbers; which of them gets which can't be told.  The result has ``group``,
    ``keys`` and ``name`` only.
    """
    cols = [*group, *keys]
    each = df.select(*cols, F.pmod(F.xxhash64(*keys), F.lit(salts)).alias("_salt")).groupBy("_salt", *cols).agg(F.count("*").alias("_n"))
    per = each.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_salt").alias("_s")).agg(F.sum("_n").alias("_rows"))
    gs = [f"_g{i}" for i in range(len(group))]
    starts = per.select(*gs, "_s", (F.sum("_rows").over(W.partitionBy(*gs).orderBy("_s")) - F.col("_rows")).alias("_start"))
    inside = W.partitionBy(*group, "_salt").orderBy(*keys)
    placed = each.withColumn("_from", F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n"))
    on = F.col("_salt") == F.col("_s")
    for c, g in zip(group, gs):
        on = on & F.col(c).eqNullSafe(F.col(g))
    joined = placed.join(F.broadcast(starts), on)
    first = F.col("_start") + F.col("_from")
    return joined.select(*cols, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(name))
