"""Benchmark decontamination by template canonicalisation.

Every text becomes two token lines: as it reads (lower case, without punctuation), and as a template, in which numbers,
names and units after numbers are typed placeholders. A capitalised word at the start of a sentence may be a name or not, so
templates are made both ways. Windows of ``WIDTH`` tokens of either line are hash-joined with
those of the benchmark, so a question turns up again when its numbers and names were swapped. A match of templates
counts only while its slots are consistent: along one alignment, what fills a slot of the item is always replaced by the
same filling in the document. One number may stand in two roles, so a number replaced by several is accepted where names and
units agree. Templates with few words count beside windows that match by themselves, or as the whole item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.llm.common import coded, slices, table
from tallyflow.llm.tokens import Remembered

WIDTH = 8
#: Items of fewer tokens can't be told from chance and aren't searched.
LEAST_TOKENS = 5
#: A template window needs so many tokens that aren't placeholders, in eighths of its width.
LITERAL = 4
#: A template with fewer, but so many, counts only along an alignment in which another window matches, or as the whole item.
FEW = 2
#: An item is leaked to a document that holds this share of its windows.
COVERAGE = 0.5
#: Windows of the benchmark whose hashes are handed to the tasks as a filter at most (8 bytes each); beyond, none is.
MOST_KNOWN = 2_000_000
UNITS = frozenset("% $ € £ g kg mg lb lbs oz ton tons t m cm mm km mi mile miles ft feet foot inch inches in yard yards l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years mph kmh dollar dollars cent cents euro euros usd eur percent degrees c f".split())
NUMBER, NAME, UNIT = 1, 2, 3
_END, _TOKEN = 4, 8
_EDGES = re.compile(r"^[^\w%$€£]+|[^\w%$€£]+$")
_NUMERIC = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_MASK = (1 << 60) - 1


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) & _MASK


def _code(chunk: str) -> int:
    """What a piece of text without blanks is, as one integer: the hash of its plain form, and flags in the low four bits."""
    bare = chunk.rstrip(",.!?")
    if bare.isalpha():  # the short way of most pieces
        word, numeric, ends = bare, False, chunk[len(bare) :][-1:] in (".", "!", "?")
    elif chunk == "\n":
        return _END
    else:
        word, ends = _EDGES.sub("", chunk), chunk.rstrip("\"'”»)]")[-1:] in tuple(".!?:;")
        numeric = _NUMERIC.fullmatch(word) is not None
    flags = _END if ends else 0
    if not word:
        return flags
    plain = word.lower()
    if numeric:
        flags |= NUMBER
    elif plain in UNITS:
        flags |= UNIT
    elif word[:1].isupper() and word[1:].islower():
        flags |= NAME
    return (_hash(plain) << 4 | _TOKEN | flags) - (1 << 63)


class _Lines:
    """The tokens of a slice's texts, one text after the other, as three lines of hashes: literal, template, and template
    whose names may begin a sentence; and which are placeholders. ``starts`` are where each text's tokens begin."""

    def __init__(self, texts: pa.Array, code) -> None:
        spaced = pc.replace_substring(pc.replace_substring(texts, "\n", " \n "), "\t", " ")
        self.distinct, self.chunks, begins = coded(pc.split_pattern(spaced, " "))
        each = np.fromiter(map(code, self.distinct), dtype=np.int64, count=len(self.distinct)).view(np.uint64)
        codes = np.where(each > np.uint64(15), each + np.uint64(1 << 63), each)[self.chunks]
        end = (codes & np.uint64(_END)) > 0
        self.at = np.nonzero(codes & np.uint64(_TOKEN))[0]
        self.starts = np.searchsorted(self.at, begins)
        ends_before = np.cumsum(end)[self.at] - end[self.at]
        tokens = codes[self.at]
        kind = (tokens & np.uint64(3)).astype(np.int8)
        self.literal = tokens >> np.uint64(4)
        opens = np.zeros(len(tokens) + 1, dtype=bool)
        opens[self.starts[:-1]] = True
        first = opens[:-1].copy()
        first[1:] |= np.diff(ends_before) > 0
        after_number = np.zeros(len(tokens), dtype=bool)
        after_number[1:] = kind[:-1] == NUMBER
        wide = np.where((kind == UNIT) & (~after_number | opens[:-1]), 0, kind)
        self.slots = np.stack([np.zeros_like(wide), np.where((kind == NAME) & first, 0, wide), wide])
        self.lines = np.where(self.slots > 0, self.slots.astype(np.uint64), self.literal)

    def windows(self, width: int) -> np.ndarray:
        """The hashes of the windows of each line, those that reach into the next text included."""
        n = self.lines.shape[1] - width + 1
        if n <= 0:
            return np.zeros((3, 0), dtype=np.int64)
        h = np.zeros((3, n), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += self.lines[:, k : k + n]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return h.view(np.int64)

    def rows(self, width: int, keep=None, whole: bool = False) -> Iterator[tuple[int, int, int, int, list[str]]]:
        """(text, form, place, hash, fillings) of windows: form 0 as it reads, 1 a template with a slot and enough words, 2 one with few.

        With ``whole``, form 3 are templates of either kind, to be compared with whole items. A filling begins with its kind.
        """
        hashes = self.windows(width)
        found = np.ones(hashes.shape, dtype=bool) if keep is None else keep(hashes.ravel()).reshape(hashes.shape)
        line, place = np.nonzero(found)
        text = np.searchsorted(self.starts, place, "right") - 1
        inside = place + width <= self.starts[text + 1]
        for line, p, text in zip(line[inside].tolist(), place[inside].tolist(), text[inside].tolist()):
            here = self.slots[line, p : p + width]
            slots = np.nonzero(here)[0]
            if line and (len(slots) == 0 or width - len(slots) < FEW):
                continue
            if line == 2 and (here == self.slots[1, p : p + width]).all():  # the same as the template before
                continue
            fills = [f"{here[k]}:{_EDGES.sub('', self.distinct[self.chunks[self.at[p + k]]]).lower()}" for k in slots]
            place = p - int(self.starts[text])
            yield text, 0 if not line else 1 if 8 * (width - len(slots)) >= LITERAL * width else 2, place, int(hashes[line, p]), fills
            if line and whole:
                yield text, 3, place, int(hashes[line, p]), fills

    def item_rows(self) -> Iterator[tuple[int, int, int, int, list[str]]]:
        """(width, form, place, hash, fillings) of the windows of an item, the only text.

        Places whose template has too few words to match are left out, unless all are like that. An item without a window
        that can match by itself once its slots change has its whole template too.
        """
        n = len(self.literal)
        if n < LEAST_TOKENS:
            return
        width = min(WIDTH, n)
        rows = list(self.rows(width))
        slotted = np.convolve(self.slots[1] > 0, np.ones(width, dtype=int), "valid")
        able = (slotted == 0) | (width - slotted >= FEW)
        for _, form, p, h, fills in rows:
            if able[p] or not able.any():
                yield width, form, p, h, fills
        if (self.slots[2] > 0).any() and not any(r[1] == 1 for r in rows):
            for _, form, p, h, fills in self.rows(n, whole=True):
                if form == 3:
                    yield n, form, p, h, fills


def _filter(known: np.ndarray):
    """Which of an array's hashes are known: one look into a table of bits for most, a search for the rest."""
    bits = np.zeros(1 << 22, dtype=bool)
    bits[known.view(np.uint64) & np.uint64((1 << 22) - 1)] = True

    def keep(h: np.ndarray) -> np.ndarray:
        maybe = bits[h.view(np.uint64) & np.uint64((1 << 22) - 1)]
        some = h[maybe]
        at = np.searchsorted(known, some)
        maybe[maybe] = known[np.minimum(at, len(known) - 1)] == some if len(known) else False
        return maybe

    return keep


def windows(texts: DataFrame, key: str, text: str, widths: list[int] | None, known: np.ndarray | None = None, whole: frozenset = frozenset()) -> DataFrame:
    """(key, width, form, place, hash, fills) of the windows of each text, those with a known hash if given.

    Without ``widths``, a text is an item and has windows of ``WIDTH`` tokens, or of all its tokens if they are fewer.
    ``whole`` are the widths of items to be compared as a whole.
    """

    names = ["key", "width", "form", "place", "hash", "fills"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())]

    def found(b: pa.RecordBatch, code, keep) -> Iterator[tuple]:
        """(row, width, form, place, hash, fillings)."""
        if widths is None:
            for row in range(b.num_rows):
                yield from ((row, *r) for r in _Lines(b.column(1).slice(row, 1), code).item_rows())
        else:
            lines = _Lines(b.column(1), code)
            for w in widths:
                yield from ((row, w, *r) for row, *r in lines.rows(w, keep, w in whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, keep = Remembered(_code).__getitem__, None if known is None else _filter(known)
        for b in slices(batches):
            some = found(b, code, keep)
            while rows := list(islice(some, 50_000)):
                at, *cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *map(pa.array, cols, types)], names)

    rows = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {texts.schema[key].dataType.simpleString()}, width int, form int, place long, hash long, fills array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, n_literal, n_swapped): one row for each item leaked to a document.

    ``n_windows`` counts the item's windows by place, where a literal or a template can match, ``n_matched`` those found in the document, as they read or as a
    template with consistent slots; ``n_literal`` counts the former; ``n_swapped`` the fillings that differ. Texts are searched whole. Null and empty texts hold nothing; items
    of fewer than ``LEAST_TOKENS`` tokens are never found. Repeated documents or items of one id count as one.

    The benchmark's window hashes, if at most ``MOST_KNOWN``, go to the tasks as a filter, so that of the documents only
    windows that can match are shuffled; a larger benchmark is joined without the filter, by the hash alone.
    """
    asked = windows(benchmark, item, item_text, None).withColumnsRenamed({"key": "item_id", "place": "item_place", "fills": "item_fills"}).distinct()
    size = asked.agg(F.countDistinct("hash").alias("n"), F.collect_set("width").alias("w"), F.collect_set(F.when(F.col("form") == 3, F.col("width"))).alias("whole")).first()
    known = None
    if size["n"] <= MOST_KNOWN:
        known = np.sort(np.array([r[0] for r in asked.select("hash").distinct().collect()], dtype=np.int64))
    found = windows(docs, key, text, sorted(size["w"]) or [WIDTH], known, frozenset(size["whole"])).withColumnRenamed("key", "doc_id").distinct()
    pairs = found.join(asked, ["hash", "width", "form"]).withColumn("shift", F.col("place") - F.col("item_place"))
    fills = F.filter(F.arrays_zip("item_fills", "fills"), lambda x: x["item_fills"].isNotNull())
    slots = pairs.select("doc_id", "item_id", "shift", F.explode(F.transform(fills, lambda x: F.struct(x["item_fills"].alias("was"), x["fills"].alias("now")))).alias("s"))
    per_slot = slots.groupBy("doc_id", "item_id", "shift", "s.was").agg(F.min("s.now").alias("least"), F.max("s.now").alias("most"))
    per_slot = per_slot.withColumn("mixed", F.col("least") != F.col("most"))
    bad = per_slot.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set(F.when(F.col("mixed"), F.col("was"))).alias("mixed"), F.max(F.col("mixed") & ~F.col("was").startswith(f"{NUMBER}:")).alias("worse"), F.sum((F.col("mixed") | (F.col("least") != F.col("was"))).cast("long")).alias("swapped"),
    )
    at = [F.col("doc_id").eqNullSafe(F.col("b_doc")), F.col("item_id").eqNullSafe(F.col("b_item")), F.col("shift") == F.col("b_shift")]
    bad = bad.select(F.col("doc_id").alias("b_doc"), F.col("item_id").alias("b_item"), F.col("shift").alias("b_shift"), "mixed", "worse", "swapped")
    good = pairs.join(bad, at, "left").where((F.col("form") == 0) | ~(F.coalesce("worse", F.lit(False)) & F.coalesce(F.arrays_overlap("item_fills", "mixed"), F.lit(False))))
    counted = good.groupBy("doc_id", "item_id", "shift", "item_place").agg(F.min("form").alias("form"), F.max(F.coalesce("swapped", F.lit(0))).alias("swapped"), F.max(F.col("form") == 3).alias("whole"))
    counted = counted.withColumn("least", F.min("form").over(W.partitionBy("doc_id", "item_id", "shift"))).withColumn("whole", F.max("whole").over(W.partitionBy("doc_id", "item_id", "shift"))).where((F.col("least") < 2) | F.col("whole"))
    counted = counted.groupBy("doc_id", "item_id", "item_place").agg(F.min("form").alias("form"), F.max("swapped").alias("swapped"), F.max("whole").alias("whole"))
    counted = counted.groupBy("doc_id", "item_id").agg(F.sum((F.col("form") < 3).cast("long")).alias("n_matched"), F.sum((F.col("form") == 0).cast("long")).alias("n_literal"), F.max("swapped").alias("n_swapped"), F.max("whole").alias("whole"))
    sizes = asked.groupBy(F.col("item_id").alias("a_item")).agg(F.countDistinct(F.when(F.col("form") == 0, F.col("item_place"))).alias("n_windows"))
    out = counted.join(sizes, F.col("item_id").eqNullSafe(F.col("a_item"))).withColumn("n_matched", F.when(F.col("whole"), F.col("n_windows")).otherwise(F.col("n_matched"))).withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    return out.where(F.col("coverage") >= coverage).select("doc_id", "item_id", "n_windows", "n_matched", "coverage", "n_literal", "n_swapped")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark that documents hold, re-parameterised or not."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE_SQL: dict[str, str] = {}
