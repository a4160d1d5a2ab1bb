"""Packing by powers of two: each document is cut into pieces whose lengths are the binary digits of its token count.

Pieces of one length form a bucket; every piece is a sequence of its own, so no sequence holds two documents and none
has padding. A document of more than the longest length begins with as many of those as fit.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import dictionary, kept, slices, table
from tallyflow.llm.tokens import Remembered, at_blanks, byte_symbols, word_splitter


def piece_lengths(n: int, longest: int) -> list[int]:
    """Lengths that sum to n: ``longest`` as often as it fits, then the rest's powers of two, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


#: Pieces that end with points or commas after a digit or a letter, plain words, and what matches nothing.
MARKED, PLAIN, NEVER = "[0-9A-Za-zÀ-ÖØ-öø-ɏ][,.]+$", "^[A-Za-z]+$", r"[^\s\S]"
#: Words and other pieces that a worker remembers; they bound memory, not results.
WORDS_KEPT, PIECES_KEPT = 400_000, 150_000


class TextIds:
    """The ids of whole texts, as the tokenizers library gives them.

    No token crosses a blank, and no merge leaves a word of the library's pattern, so the distinct pieces between blanks of a
    slice of texts are cut into words, and the library's model encodes each new word once. Pieces and words are remembered
    in caches of bounded size. Pieces with special strings go to the library whole.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        encode, stand_in, words_in = tokenizer.model.tokenize, dict(enumerate(byte_symbols())), word_splitter()

        def word(w: str) -> bytes:
            symbols = w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(stand_in)
            return _little([t.id for t in encode(symbols)])

        word = self.word = Remembered(word, WORDS_KEPT).__getitem__

        def piece(p: str) -> bytes:
            if not p.isalnum() and any(s in p for s in special):
                return _little(tokenizer.encode(p, add_special_tokens=False).ids)
            return b"".join(map(word, words_in(p)))

        self.piece = Remembered(piece, PIECES_KEPT).__getitem__
        self.marked = MARKED if not any("," in s or "." in s for s in special) else NEVER

    def known(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece.

        Arrow takes points and commas off the ends of words and lower-cases plain words, so that what is left comes more
        often; of that, each kind is a Python object once.
        """
        bare = pc.if_else(pc.match_substring_regex(pieces, self.marked), pc.utf8_rtrim(pieces, ",."), pieces)
        plain = pc.match_substring_regex(bare, PLAIN)
        mark = pc.if_else(pc.equal(bare, pieces), "", pc.replace_substring_regex(pieces, r"^.*[^,.]", ""))
        words, others = pc.ascii_lower(bare.filter(plain)).dictionary_encode(), bare.filter(pc.invert(plain)).dictionary_encode()
        spelled = pa.concat_arrays([_ids(self.word, words), _ids(self.piece, others)])
        place = np.empty(len(pieces), dtype=np.int64)
        place[np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(pieces))
        ended = _ids(lambda m: self.word(m) if m else b"", mark.dictionary_encode())
        return pc.binary_join_element_wise(spelled.take(pa.array(place)), ended, pa.scalar(b"", pa.large_binary()))

    def __call__(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one text after the other with ``end`` after each, and where each text's begin."""
        distinct, codes, starts = dictionary(at_blanks(texts))
        codes = np.insert(codes.astype(np.int64), starts[1:], len(distinct))
        found = pa.concat_arrays([self.known(distinct), pa.array([end], pa.large_binary())]).take(pa.array(codes))
        _, ends, held = found.buffers()
        bounds = np.frombuffer(ends, dtype=np.int64)[: len(found) + 1] // 4
        return np.frombuffer(held, dtype="<u4", count=bounds[-1]), bounds[starts + np.arange(len(starts))]


def _ids(of: Callable[[str], bytes], coded: pa.DictionaryArray) -> pa.Array:
    return pa.array(list(map(of, coded.dictionary.to_numpy(zero_copy_only=False).tolist())), pa.large_binary()).take(coded.indices)


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, longest: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, 4 little-endian bytes each), doc_tokens, bucket, sequence_id.

    ``bucket`` is log2 of the length; ``write.partitionBy("bucket")`` gives files of equal lengths. ``sequence_id`` comes
    from the partition and the place in it, so no shuffle is needed, and a task that runs again gives the same ids as long
    as its input does, which holds for files and checkpoints. A null text is the empty one: its single token is
    ``end_id``. Repeated rows are packed each on their own; other columns aren't read; an empty table gives an empty result.
    ``longest`` is a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = kept(("ids", vocabulary), lambda: TextIds(vocabulary))
        for b in slices(batches):
            ids, bounds = ids_of(b.column(1), end_id.to_bytes(4, "little"))
            totals = np.diff(bounds)
            each = [piece_lengths(n, longest) for n in totals.tolist()]
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in each])
            lengths = np.fromiter(chain.from_iterable(each), dtype=np.int64, count=len(row))
            ends = np.cumsum(lengths)
            # pieces lie one after the other, so their binary values share the buffer of all ids
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.concatenate([[0], 4 * ends])), pa.py_buffer(ids)])
            columns = [b.column(0).take(pa.array(row)), pa.array(ends - lengths - bounds[row]), pa.array(lengths), held.cast(pa.binary()), pa.array(totals[row])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    return pieces.withColumn("bucket", F.log2("length").cast("int")).withColumn("sequence_id", F.monotonically_increasing_id())


def digest(pieces: DataFrame, with_ids: bool = False) -> DataFrame:
    """The pieces with the CRC-32 of their ids, and the ids too if asked for; a piece begins its sequence."""
    ids = ["ids"] if with_ids else []
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "bucket", *ids)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of powers of two up to 2048, with the CRC-32 of each piece's ids."""
    import public_tokenizers

    return digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
