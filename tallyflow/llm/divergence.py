"""How far the sources of a language differ in their words: a divergence audit of all pairs of sources.

Texts become counts per (language, source, term), one row for many occurrences. Terms of a language are dealt by hash to
chunks of about ``CHUNK`` terms and numbered inside their chunk, so a group's counts are packed vectors, one per chunk, of
positions and counts. The matrix of all pairs of a language's groups is tiled in two dimensions: groups are dealt to blocks of
``BLOCK``, and a tile is a pair of blocks. Each group's vectors are sent to all tiles of its block's row or column; a tile's
task reads them chunk by chunk, so it holds two blocks' vectors of one chunk and its own submatrix, whatever the vocabulary.
``SPAN`` chunks are one task; the tasks of a tile add up.

All shares are whole billionths and all sums whole numbers, so results don't depend on any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.llm.common import coded, cut, slices, small_side, stored, table

LEAST_DOCS, SMOOTH, BILLION, TOP = 30, 5, 1_000_000_000, 50
CHUNK, SPAN, BLOCK = 4096, 16, 32

#: Bytes of UTF-8 as terms have them: A-Z in lower case, a-z and all bytes of other characters as they are, space for the rest.
_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


def _terms(texts: pa.StringArray) -> pa.ListArray:
    """The texts' terms: only single ASCII bytes change, so the text stays valid UTF-8 of the same length."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    mapped = _BYTES[np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]] if data else np.empty(0, np.uint8)
    return pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(mapped)))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a null term for the group itself.

    Null lang, source and text count as empty. Equal rows count each time; an empty table has no groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 1 << 23):
            groups = pa.StructArray.from_arrays([b.column(0), b.column(1)], ["lang", "source"]).to_pylist()
            number: dict[tuple, int] = {}
            of = np.array([number.setdefault((g["lang"], g["source"]), len(number)) for g in groups])
            distinct, codes, starts = coded(_terms(b.column(2)))
            row = np.repeat(np.arange(b.num_rows), np.diff(starts))
            some = np.array([t != "" for t in distinct], dtype=bool)[codes]
            row, codes, d = row[some], codes[some].astype(np.int64), max(1, len(distinct))
            in_doc, n = np.unique(row * d + codes, return_counts=True)
            cell, back = np.unique(of[in_doc // d] * d + in_doc % d, return_inverse=True)
            count, found = np.bincount(back, n, len(cell)).astype(np.int64), np.bincount(back, minlength=len(cell))
            names = list(number)
            g = np.concatenate([cell // d, np.arange(len(names))])
            terms = [distinct[k] for k in (cell % d).tolist()] + [None] * len(names)
            nothing = np.zeros(len(names), dtype=np.int64)
            out = [pa.array([x[i] for x in names], pa.string()).take(pa.array(g)) for i in (0, 1)]
            out += [pa.array(terms, pa.string()), pa.array(np.concatenate([count, nothing])), pa.array(np.concatenate([found, nothing]))]
            for i in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(i, 100_000) for c in out], ["lang", "source", "term", "n", "docs"])

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str, smooth: int = SMOOTH) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)) as a long, worked out in decimals."""
    return F.expr(f"1 + cast({BILLION} as decimal(10,0)) * (cast({count} as decimal(20,0)) + {smooth}) div (cast({total} as decimal(20,0)) + {smooth} * cast({terms} as decimal(17,0)))")


def _shares(count: np.ndarray, total: int, smooth: int) -> np.ndarray:
    """The same for counts of a group and its ``total`` + 5 terms, by long division three digits at a time."""
    out, rest = np.divmod(count + smooth, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, smooth: int = SMOOTH, chunk: int = CHUNK, span: int = SPAN, block: int = BLOCK, **names: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, kept, pairs) of the audit.

    ``groups``: (lang, source, g, total, terms): a language's groups numbered from 0, their occurrences of kept terms and the
    language's kept terms V. ``kept``: (lang, source, term, n, everywhere): counts of kept terms in groups and in the language.
    ``pairs``: (lang, x, y, value), x < y: the summed differences of two groups' shares over all kept terms.
    """
    counts = stored(term_counts(docs, **names))
    vocabulary = cut(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("everywhere")).where(F.col("docs") >= least_docs).select("lang", "term", "everywhere"))
    langs = small_side(vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("everywhere").alias("lang_total")))
    kept = stored(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "everywhere"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    numbered = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = small_side(groups.select("lang", "source", numbered.alias("g"), zero("total"), zero("terms"), zero("lang_total")))

    # a term's chunk is by hash and its place counted inside, so no task numbers a whole vocabulary
    placed = vocabulary.join(langs, "lang").select("lang", "term", F.pmod(F.xxhash64("term"), F.expr(f"(terms + {chunk - 1}) div {chunk}")).alias("chunk"))
    inside = W.partitionBy("lang", "chunk")
    placed = cut(placed.select("lang", "term", "chunk", (F.row_number().over(inside.orderBy("term")) - 1).cast("int").alias("at"), F.count("*").over(inside).cast("int").alias("width")))
    widths = placed.groupBy("lang", F.expr(f"chunk div {span}").alias("span")).agg(F.count("*").alias("all_width"))
    packed = kept.join(placed, ["lang", "term"]).groupBy("lang", "source", "chunk", "width").agg(F.collect_list(F.struct("at", "n")).alias("cells"))  # a chunk's terms at most
    packed = packed.join(groups, ["lang", "source"]).select("lang", "g", "chunk", "width", F.col("cells.at").alias("at"), F.col("cells.n").alias("n"))
    return groups, kept, tiled(groups, packed, widths, smooth, chunk, span, block)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (lang, span, i, j, chunk, g, width, total, at, n), the last two as integer arrays."""
    for b in batches:
        plain = zip(*(b.column(k).to_pylist() for k in range(8)))
        for k, row in enumerate(plain):
            yield *row, *(b.column(c)[k].values.to_numpy() for c in (8, 9))


def tiled(groups: DataFrame, packed: DataFrame, widths: DataFrame, smooth: int, chunk: int, span: int, block: int) -> DataFrame:
    """(lang, x, y, value): the pairs of each tile, a pair of blocks, over spans of successive chunks.

    A tile has a row for each of its groups in each span, without cells, that tells the group's total and the span's terms; so
    chunks that no group of the tile has, and groups without any term, are part of the sums as well.
    """
    tiles = F.expr(f"transform(sequence(0, blocks - 1), k -> struct(least(k, g div {block}) as i, greatest(k, g div {block}) as j))")
    blocks = F.expr(f"cast(max(g) over (partition by lang) div {block} + 1 as int)")
    sides = small_side(groups.select("lang", "g", "total", "terms", blocks.alias("blocks")))
    spans = F.expr(f"sequence(0L, greatest(1L, (terms + {chunk * span - 1}) div {chunk * span}) - 1)")
    heads = sides.select("lang", "g", F.explode(spans).alias("span"), F.lit(-1).cast("long").alias("chunk"), (F.col("total") + smooth * F.col("terms")).alias("total"), F.explode(tiles).alias("t"))
    heads = heads.join(widths, ["lang", "span"], "left").select("lang", "span", "t.*", "chunk", "g", F.coalesce("all_width", F.lit(0)).cast("int").alias("width"), "total", F.expr("cast(array() as array<int>)").alias("at"), F.expr("cast(array() as array<bigint>)").alias("n"))
    cells = packed.join(sides.select("lang", "g", "blocks"), ["lang", "g"]).select("lang", F.expr(f"chunk div {span}").alias("span"), F.explode(tiles).alias("t"), "chunk", "g", "width", F.lit(0).cast("long").alias("total"), "at", "n")
    rows = heads.unionByName(cells.select("lang", "span", "t.*", "chunk", "g", "width", "total", "at", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, _, i, j), found in groupby(_rows(batches), key=lambda r: r[:4]):
            found = groupby(found, key=lambda r: r[4])
            heads = list(next(found)[1])  # the tile's groups, chunk -1, come first
            total, unseen = {r[5]: r[7] for r in heads}, heads[0][6]
            number = {g: k for k, g in enumerate(total)}
            x, y = (np.array([g for g in total if g // block == k], dtype=np.int64) for k in (i, j))
            rx, ry = ([number[g] for g in side.tolist()] for side in (x, y))
            least = np.array([_shares(np.zeros(1, dtype=np.int64), t, smooth)[0] if unseen else 0 for t in total.values()])
            sums = np.zeros((len(x), len(y)), dtype=np.int64)
            for _, of_chunk in found:
                vectors = None
                for r in of_chunk:
                    if vectors is None:
                        vectors = np.repeat(least[:, None], r[6], axis=1)
                        unseen -= r[6]
                    vectors[number[r[5]], r[8]] = _shares(r[9], total[r[5]], smooth)
                for a, k in enumerate(rx):
                    sums[a] += np.abs(vectors[ry] - vectors[k]).sum(1)
            sums += unseen * np.abs(least[rx][:, None] - least[ry][None])
            a, b = np.nonzero(x[:, None] < y[None])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(x[a], pa.int32()), pa.array(y[b], pa.int32()), pa.array(sums[a, b], pa.int64())], ["lang", "x", "y", "value"])

    rows = rows.select("lang", "span", "i", "j", "chunk", "g", "width", "total", "at", "n")
    dealt = rows.repartition("lang", "span", "i", "j").sortWithinPartitions("lang", "span", "i", "j", "chunk", "g")
    return dealt.mapInArrow(run, "lang string, x int, y int, value long").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, smooth: int = SMOOTH, chunk: int = CHUNK, span: int = SPAN, block: int = BLOCK, **names: str) -> DataFrame:
    """(lang, source, part, item, value long, rank int) for every occurring (lang, source).

    Part ``pair``: the language's other sources by the summed difference of shares, all of them. Part ``term``: the ``top`` kept
    terms by which the group's share exceeds the language's. Ranks by value, then by the item's UTF-8 bytes.
    Null lang, source and text count as empty, repeated rows each time; an empty table gives an empty result. Other columns
    aren't read. A language without kept terms has pairs of value 0.
    """
    groups, kept, pairs = audited(docs, least_docs, smooth, chunk, span, block, **names)
    both = pairs.select("lang", F.col("x").alias("g"), F.col("y").alias("o"), "value").unionAll(pairs.select("lang", F.col("y").alias("g"), F.col("x").alias("o"), "value"))
    other = groups.select("lang", F.col("g").alias("o"), F.col("source").alias("item"))
    pair = both.join(groups.select("lang", "source", "g"), ["lang", "g"]).join(other, ["lang", "o"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    p, q = share("n", "total", "terms", smooth), share("everywhere", "lang_total", "terms", smooth)
    above = kept.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    ranks = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = above.withColumn("rank", ranks).where(F.col("rank") <= top)
    return pair.withColumn("rank", ranks).unionByName(ranked).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of ``documents`` against the other sources of its language and against the language; null values are empty."""
    return audit(table(spark, sf_dir, "documents"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
QUERIES = {"op12_divergence_audit": op12_divergence_audit}
ORACLE_SQL: dict[str, str] = {
    "op12_divergence_audit": rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
found AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS n FROM found GROUP BY lang, source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
  1 + (CAST({BILLION} AS HUGEINT) * (coalesce(f.n, 0) + {SMOOTH})) // (coalesce(t.n, 0) + {SMOOTH} * l.v) AS p,
  1 + (CAST({BILLION} AS HUGEINT) * (k.n + {SMOOTH})) // (l.n + {SMOOTH} * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP}"""
}
