"""Token counts by byte-pair merging over a heap and a linked list, without emitting identifiers.

A word's count is its number of initial symbols minus its merges, so merging needs no vocabulary lookups: the adjacent
pair of the lowest rank is popped from a heap, joined in a doubly linked list of symbols, and its two new neighbours are
pushed, until no pair has a rank. Texts are cut at blanks first, which no token crosses; each distinct piece of a slice of
texts is looked up or merged once, and remembered in a cache of bounded size.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import coded, kept, slices, table

#: Pieces that a worker remembers at most, and the longest that it does; they bound memory, not results.
CACHE, LONGEST = 300_000, 64


class Remembered(dict):
    """A function's results by argument, as a dict that fills itself and holds about ``size`` of them.

    When it is half full, what it holds becomes the old half, and the old half before that, unless asked for since, goes.
    Long arguments aren't held. ``__getitem__`` is the fast way in; a call does the same.
    """

    def __init__(self, of: Callable, size: int = CACHE):
        super().__init__()
        self.of, self.half, self.old = of, max(1, size // 2), {}

    def __missing__(self, x):
        if len(x) > LONGEST:
            return self.of(x)
        found = self.old.get(x)
        if found is None:
            found = self.of(x)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[x] = found
        return found

    def __call__(self, x):
        return self[x]


def pair_ranks(path: str) -> dict[tuple[str, str], int]:
    """The merges of a tokenizers file, by their two symbols."""
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    return {tuple(m.split(" ") if isinstance(m, str) else m): rank for rank, m in enumerate(merges)}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def lowered(s: str) -> str:
    """Lower case by character: no final form of sigma."""
    return "".join(c.lower() for c in s) if "Σ" in s else s.lower()


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no adjacent pair has a rank; ties go to the leftmost pair."""
    n = len(symbols)
    if n < 2:
        return n
    after, before, at = [*range(1, n), -1], [*range(-1, n - 1)], list(symbols)
    heap = [(r, i, p) for i, p in enumerate(zip(at, at[1:])) if (r := ranks.get(p)) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j < 0 or at[i] != pair[0] or at[j] != pair[1]:  # one side was merged meanwhile
            continue
        at[i], at[j] = pair[0] + pair[1], ""
        k = after[i] = after[j]
        after[j] = -1
        left -= 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get(p := (at[i], at[k]))) is not None:
                heapq.heappush(heap, (r, i, p))
        h = before[i]
        if h >= 0 and (r := ranks.get(p := (at[h], at[i]))) is not None:
            heapq.heappush(heap, (r, h, p))
    return left


#: The words of the library's pattern for files like word_bpe_49k.json.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def word_splitter() -> Callable[[str], list[str]]:
    """From a piece without blanks and special strings to its words by ``WORDS``, normalised. Plain words take the short way."""
    import regex

    in_words = regex.compile(WORDS).findall

    def words(p: str) -> list[str]:
        bare = p.rstrip(",.")
        if bare.isascii() and bare.isalpha():
            return [bare.lower()] if len(bare) == len(p) else [bare.lower(), p[len(bare) :]]
        low = lowered(unicodedata.normalize("NFC", p))
        return [low] if low.isalpha() else in_words(low)

    return words


def at_blanks(texts: pa.Array) -> pa.ListArray:
    """Each text's pieces between blanks and line ends, which no token crosses; of an empty text, one empty piece."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Counts the tokens of each text as the tokenizers file at ``path`` gives them, without added ones.

    It covers files like word_bpe_49k.json: NFC, white space collapsed, lower case, words split by ``WORDS``,
    bytes as symbols, the last symbol of a word marked. Special strings in a text count as one token each.
    """
    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    mark = spec["model"]["end_of_word_suffix"] or ""
    special = [t["content"] for t in spec["added_tokens"]]
    ranks, stand_in = pair_ranks(path), byte_symbols()
    at_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    words_in = word_splitter()

    def word(w: str) -> int:
        symbols = [stand_in[b] for b in w.encode()]
        symbols[-1] += mark
        return merged_count(symbols, ranks)

    word = Remembered(word).__getitem__

    def piece(s: str) -> int:
        if at_special and not s.isalnum() and at_special.search(s):
            return sum(word(w) for part in at_special.split(s) for w in words_in(part)) + len(at_special.findall(s))
        return sum(map(word, words_in(s)))

    piece = Remembered(piece).__getitem__

    def count(texts: pa.Array) -> np.ndarray:
        distinct, codes, starts = coded(at_blanks(texts))
        each = np.fromiter(map(piece, distinct), dtype=np.int64, count=len(distinct))
        return np.add.reduceat(each[codes], starts[:-1])

    return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, whole texts, in one pass without a shuffle.

    ``vocabulary`` is the path of the tokenizers file on the executors. A null text is the empty one: no bytes, no
    tokens. Repeated rows stay; other columns aren't read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = kept(("counts", vocabulary), lambda: counter(vocabulary))
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count(b.column(1)))], ["doc_id", "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), t.alias("text"), F.octet_length(t).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, counted by the merges of word_bpe_49k.json."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict[str, str] = {}
