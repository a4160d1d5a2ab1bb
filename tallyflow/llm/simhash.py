"""SimHash near-duplicates: fingerprints, links between them, and the components that the links make.

Two fingerprints at Hamming distance d or less are found in the space of segment popcounts. A fingerprint is embedded
as the vector of bit counts of its short segments; the Manhattan distance of two vectors is a lower bound of the Hamming
distance. So near fingerprints lie within d of each other on that integer grid, and a range join there misses none. The
grid is joined by cells: the vector is cut into ``BLOCKS`` blocks; two vectors within d differ in at most d blocks, so
they agree on at least ``BLOCKS - d`` of them, and every choice of that many blocks is a grid in which they share a
cell. Within a cell, pairs must pass the Manhattan bound, and then the exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import WORD, components, cut, small_side, slices, strings, table

BITS, SEGMENT = 64, 2
_LOW = 0x5555555555555555
#: Lower-cases A to Z only.
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint long): bit k is 1 if it is set in over half of the hashes of the text's word shingles.

    Repeated shingles count each time; a text with fewer words is one shingle; one without words, or null, has 0.
    Repeated rows stay. Texts are hashed whole, one at a time, where they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np
        import xxhash

        find, digest = re.compile(WORD).findall, xxhash.xxh64_intdigest

        def fingerprint(t: str) -> int:
            words = [w.encode() for w in find(t.translate(_LOWER))]
            if not words:
                return 0
            line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
            n = max(1, len(words) - shingle + 1)
            last = ends[shingle - 1 :].tolist() or [len(line)]
            hashes = np.array([digest(line[a:b], 42) for a, b in zip([0, *(ends[: n - 1] + 1).tolist()], last, strict=True)], dtype="<u8")
            ones = np.zeros(BITS, dtype=np.int64)
            for i in range(0, n, 1 << 16):
                ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])

        for b in slices(batches):
            found = [fingerprint(t) for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, fingerprint long")


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def popcounts(f: str) -> Column:
    """The embedding: one long whose k-th pair of bits holds the number (0, 1 or 2) of ones in the k-th segment."""
    low, high = F.col(f).bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(F.col(f), 1).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def manhattan(a: str, b: str) -> Column:
    """The distance of two fingerprints' embeddings. In unary code (00, 01, 11) a difference of counts is a number of bits."""
    unary = lambda x: popcounts(x).bitwiseOR(F.shiftrightunsigned(popcounts(x), 1).bitwiseAND(F.lit(_LOW)))
    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def cells(distance: int, blocks: int) -> list[int]:
    """For each choice of ``blocks - distance`` blocks of segments: the mask of their bits, as a signed long."""
    n, out = BITS // SEGMENT, []
    edges = [round(k * n / blocks) for k in range(blocks + 1)]
    for chosen in combinations(range(blocks), blocks - distance):
        m = sum(((1 << SEGMENT) - 1) << (SEGMENT * s) for k in chosen for s in range(edges[k], edges[k + 1]))
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def links(prints: DataFrame, distance: int = 4, blocks: int = 7) -> DataFrame:
    """All pairs (a, b), a > b, of the distinct longs ``fingerprint`` that differ in ``distance`` bits or fewer, without
    those that neighbours imply.

    First, fingerprints that are equal but for one nibble are hung under the smallest of them: all of such a group are
    within 4 bits of each other, so a star says as much as all pairs. These stars' components then are one side each of
    the grid join, which looks for pairs of different components only: a dense cloud of near copies doesn't
    become all of its pairs. Components of the result are those of all pairs.
    """
    nibbles = [(15 << s) - ((1 << 64) if s == 60 else 0) for s in range(0, BITS, 4)]
    if distance >= 4:
        one = prints.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(~m)) for m in nibbles])).alias("nibble", "rest"))
        group = one.groupBy("nibble", "rest").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("top")).where("top > b")
        stars = cut(one.join(group, ["nibble", "rest"]).where("fingerprint > b").select(F.col("fingerprint").alias("a"), "b").distinct())
        known = components(stars)
    else:
        stars = prints.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).limit(0)
        known = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    rows = prints.join(known, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("c"), popcounts("fingerprint").alias("p"))
    rows = rows.select("fingerprint", "c", F.posexplode(F.array(*[F.col("p").bitwiseAND(F.lit(m)) for m in cells(distance, blocks)])).alias("grid", "cell"))
    x, y = (rows.select("grid", "cell", F.col("fingerprint").alias(s), F.col("c").alias(f"c{s}")).alias(f"of_{s}") for s in "ab")
    near = (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & (manhattan("a", "b") <= distance) & (hamming("a", "b") <= distance)
    found = x.hint("merge").join(y, (F.col("of_a.grid") == F.col("of_b.grid")) & (F.col("of_a.cell") == F.col("of_b.cell")) & near)
    return found.select("a", "b").distinct().unionAll(stars)


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id): documents linked by fingerprints ``distance`` or fewer bits apart.

    Equal fingerprints are one node, so exact copies, however many, cost nothing after the first group-by.
    component_id is the smallest doc_id of the component, the document's own included. Null ids are never the smallest
    unless there is no other. Repeated rows stay; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, shingle, key, text))
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fingerprint"), distance, blocks))
    classes = nodes.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("c"))
    ids = cut(classes.groupBy("c").agg(F.min("least").alias("component_id")))  # stored, so that the join below can split a hot component
    named = classes.join(ids, "c").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays per near-duplicate group.

    It is the row of the smallest id, null ids last; of several with that id, the one of the least hash of the text, then of
    the whole row; of equal rows any. Ids need not be unique: rows are judged each by its text.
    """
    row = F.struct(docs[key].isNull().alias("no_id"), docs[key].alias("id"), F.xxhash64(docs[text]).alias("text"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("row"))
    classes = cut(near_duplicates(docs.select(row.alias("row"), docs[text].alias("text")), distance, shingle, blocks, "row", "text").select("doc_id", "component_id"))
    gone = small_side(classes.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(gone, row == gone["doc_id"], "left_anti")
    again = small_side(classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    same = row == again["doc_id"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates())


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest document that links of 4 bits or fewer reach."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_dedup": op4_simhash_dedup}
ORACLE_SQL: dict[str, str] = {}
