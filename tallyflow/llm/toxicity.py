"""Toxicity by Levenshtein automata run over a lexicon trie, with context windows that tell quotation from abuse.

The lexicon is learned: words, and stems that words begin with, that labelled toxic texts hold far more often than
others. The texts' words are matched against all terms at once: the automaton of each term up to its edit distance is
intersected with the trie of all terms, and the product is made deterministic state by state as words need it, so a word
costs one table lookup a letter and most words die within a few. What is found is weighed by its context: a hit
in a span of quotation marks, or shortly after a reporting word, counts as quoted. A logistic model over the counts gives the
score. It is cross-fitted: each labelled row is measured with a lexicon that was learned without the row's fold.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import coded, cut, forget, slices, table
from tallyflow.llm.tokens import Remembered, at_blanks

#: Labelled rows that are learned from at most, the same ones in every run: those of the least hashes.
TRAIN_ROWS = 20_000
#: A stem is one of these numbers of first letters of a word.
STEMS = (4, 5, 6, 7)
#: A term must be in so many toxic texts, and in so many times the share of the others'.
LEAST_TEXTS, LEAST_LIFT = 5, 12.0
#: Of few toxic texts, this share of them and 3 at least will do.
LEAST_SHARE = 0.25
#: Parts of the labelled rows; the weights see each with a lexicon of the others.
FOLDS = 4
#: An automaton of more states than these begins anew; it changes no match.
MOST_STATES = 150_000
#: Words on each side of a hit that are its context.
WINDOW = 6
REPORTING = frozenset("said says say called calls wrote writes quoted quote quoting word words term slur dijo escribió palabra dit mot écrit sagte schrieb wort".split())
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"


def bounds(term: str, stem: bool) -> int:
    """The edit distance within which a word still matches a term: short terms and stems match exactly."""
    return 0 if stem or len(term) < 5 else 1 if len(term) < 8 else 2


class FuzzyTrie:
    """All terms in one trie, matched within each term's own distance by a lazily made deterministic automaton.

    A state is a set of (trie node, edits so far), each node with its fewest edits. ``match`` gives (term, edits) of the
    best term: fewest edits, then the longer term, then by its letters; or None. A stem matches any word it begins.
    """

    def __init__(self, terms: dict[str, bool]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, bool]]] = [[]]
        self.reach: list[int] = [0]
        for term, stem in sorted(terms.items()):
            k, at = bounds(term, stem), 0
            self.reach[0] = max(self.reach[0], k)
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.reach.append(0)
                at = self.next[at][c]
                self.reach[at] = max(self.reach[at], k)
            self.ends[at].append((term, stem))
        self.letters = {c for step in self.next for c in step}
        self._begin()

    def _begin(self) -> None:
        """Forgets all states but the first; they are made anew as words ask for them."""
        start = self._closed({0: 0})
        self.states: dict[frozenset, int] = {start: 0}
        self.sets = [start]
        self.steps: list[dict[str, int]] = [{}]
        self.found: list = [self._found(start)]

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """With the nodes that dropping letters of a term reaches."""
        todo = list(nodes.items())
        while todo:
            at, e = todo.pop()
            if nodes[at] < e:
                continue
            for to in self.next[at].values():
                if e + 1 <= self.reach[to] and e + 1 < nodes.get(to, 99):
                    nodes[to] = e + 1
                    todo.append((to, e + 1))
        return frozenset(nodes.items())

    def _found(self, state: frozenset) -> tuple:
        """(best whole match here, best stem that ends here)."""
        whole = min(((e, -len(t), t) for at, e in state for t, stem in self.ends[at] if e <= bounds(t, stem)), default=None)
        stem = min(((e, -len(t), t) for at, e in state for t, s in self.ends[at] if s and e == 0), default=None)
        return whole, stem

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def put(at: int, e: int) -> None:
            if e <= self.reach[at] and e < nodes.get(at, 99):
                nodes[at] = e

        for at, e in self.sets[state]:
            put(at, e + 1)  # c is one too many
            for letter, to in self.next[at].items():
                put(to, e + (letter != c))
        found = self._closed(nodes)
        if found not in self.states:
            self.states[found] = len(self.sets)
            self.sets.append(found)
            self.steps.append({})
            self.found.append(self._found(found))
        self.steps[state][c] = self.states[found]
        return self.states[found]

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.sets) > MOST_STATES:
            self._begin()
        state, best = 0, None
        steps, letters = self.steps, self.letters
        for c in word:
            if c not in letters:
                c = ""
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            stem = self.found[state][1]
            if stem is not None and (best is None or stem < best):
                best = stem
            if not self.sets[state]:
                break
        else:
            whole = self.found[state][0]
            if whole is not None and (best is None or whole < best):
                best = whole
        return None if best is None else (best[2], best[0])


@dataclass
class Model:
    """``terms``: term to (is a stem, its log-odds). ``weights``: of ``features``, the intercept first."""

    terms: dict[str, tuple[bool, float]] = field(default_factory=dict)
    weights: tuple[float, ...] = (-2.0, 1.0, 1.0, 0.5, 0.0, 0.0, 0.0)


_plain = re.compile(r"[^\W\d_]+").findall
_edges = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def letters(chunk: str) -> list[str]:
    """The words in a piece of text, in lower case and NFC: runs of letters, and the whole piece between its first and last
    letter where digits or symbols stand inside, as in disguised words."""
    low = unicodedata.normalize("NFC", chunk).lower()
    found = _plain(low)
    return [*found, _edges.sub("", low)] if len(found) > 1 else found


def matcher(model: Model):
    """From a text's pieces without blanks to the best match in each, remembered."""
    trie = FuzzyTrie({t: stem for t, (stem, _) in model.terms.items()})

    def best(chunk: str):
        hits = [(-model.terms[m[0]][1], m) for w in letters(chunk) if (m := trie.match(w))]
        return min(hits)[1] if hits else ()

    return Remembered(best)


def quoted(chunks: list[str], at: int) -> bool:
    """Whether the hit stands in quotation marks opened and closed within the window, or after a reporting word."""
    if any(w in REPORTING for c in chunks[max(0, at - WINDOW) : at] for w in letters(c)):
        return True
    opened = any(c[:1] in OPENING for c in chunks[max(0, at - WINDOW) : at + 1] if c)
    closed = any(c.rstrip(".,;:!?")[-1:] in CLOSING for c in chunks[at : at + WINDOW + 1] if c.rstrip(".,;:!?"))
    return opened and closed


def features(texts: pa.Array, find, model: Model) -> np.ndarray:
    """A row a text: whole-word hits, stem hits, fuzzy hits, quoted hits (each as log1p), summed log-odds, hits per 100 words."""
    distinct, codes, starts = coded(at_blanks(texts))
    best = [*map(find.__getitem__, distinct)]
    hit = np.flatnonzero(np.fromiter(map(bool, best), dtype=bool, count=len(best))[codes])
    out = np.zeros((len(texts), 6))
    for row, mine in groupby(zip((np.searchsorted(starts, hit, "right") - 1).tolist(), hit.tolist()), lambda x: x[0]):
        a, b = int(starts[row]), int(starts[row + 1])
        chunks, n, odds = [distinct[c] for c in codes[a:b].tolist()], [0.0] * 4, 0.0
        for _, i in mine:
            term, edits = best[codes[i]]
            stem, weight = model.terms[term]
            if quoted(chunks, i - a):
                n[3] += 1
            else:
                n[2 if edits else 1 if stem else 0] += 1
                odds += weight / (1 + edits)
        out[row] = [*np.log1p(n), min(odds, 30.0) / 10, min(100.0 * sum(n[:3]) / (b - a), 20.0) / 10]
    return out


def train_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    """(text, y, fold) of at most ``rows`` labelled documents outside the held-out fifth, those of the least hashes.

    Of repeated rows of one id, the one of the least text counts, so ``rows`` bounds what is learned from.
    """
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_id")
    body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = body.join(F.broadcast(some), F.col("_key") == F.col("_id")).groupBy("_id", "y").agg(F.min("text").alias("text"))
    return found.select("text", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"))


def learn_terms(rows: DataFrame) -> list[dict[str, tuple[bool, float]]]:
    """Words and stems that toxic texts hold far more often than others, with their log-odds: for each fold those learned
    without it, and at the end those of all rows.

    Counted in Spark over distinct words a text, once for all folds. What is collected passed a test on counts of a bounded
    sample, so it is a lexicon, whatever the corpus. A stem is taken only where many different words carry it, none much
    alone, and replaces the words that begin with it; of nested stems the shortest that holds stays.
    """
    words = rows.select("y", "fold", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)"))).alias("w")).where("length(w) between 3 and 40")
    stems = F.array(*[F.when(F.length("w") > n, F.struct(F.substring("w", 1, n).alias("t"), F.lit(True).alias("stem"))) for n in STEMS])
    of_word = words.groupBy("w").agg(*[F.sum(F.when((F.col("fold") == k) & (F.col("y") == y), 1).otherwise(0)).alias(f"{s}{k}") for k in range(FOLDS) for s, y in (("p", 1), ("n", 0))])
    terms = of_word.select("*", F.explode(F.array_append(F.filter(stems, lambda s: s.isNotNull()), F.struct(F.col("w").alias("t"), F.lit(False).alias("stem")))).alias("x"))
    without = [[k for k in range(FOLDS) if k != v] for v in range(FOLDS + 1)]
    parts = []
    for v, folds in enumerate(without):
        p, n = (sum((F.col(f"{s}{k}") for k in folds), F.lit(0)) for s in "pn")
        parts.append(F.struct(F.sum(p).alias("p"), F.sum(n).alias("n"), F.max(p).alias("most"), F.sum(F.when(p > 0, 1).otherwise(0)).alias("kinds")).alias(f"v{v}"))
    counts = terms.groupBy("x.t", "x.stem").agg(*parts)
    seen = {(r["fold"], int(r["y"])): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    lifts = []
    for v, folds in enumerate(without):
        all_p, all_n = (sum(seen.get((k, y), 0) for k in folds) for y in (1, 0))
        p, n, most, kinds = (F.col(f"v{v}.{c}") for c in ("p", "n", "most", "kinds"))
        lift = (p / max(1, all_p)) / ((n + 1) / max(1, all_n))
        least = min(LEAST_TEXTS, max(3, LEAST_SHARE * all_p))
        # the share of a stem's occurrences must stay well above what the others' texts explain
        held = (p >= least) & (lift >= LEAST_LIFT) & (~F.col("stem") | ((kinds >= 5) & (most <= 0.6 * p) & (p >= 2 * LEAST_TEXTS)))
        lifts.append(F.when(held, lift).alias(f"l{v}"))
    good = counts.select("t", "stem", *lifts).where(F.coalesce(*[f"l{v}" for v in range(FOLDS + 1)]).isNotNull()).collect()
    return [_lexicon({(r["t"], r["stem"]): float(np.log(r[f"l{v}"])) for r in good if r[f"l{v}"] is not None}) for v in range(FOLDS + 1)]


def _lexicon(found: dict[tuple[str, bool], float]) -> dict[str, tuple[bool, float]]:
    """The terms without those that a shorter stem among them stands for."""
    stem_set = {t for t, stem in found if stem}
    stem_set = {t for t in stem_set if not any(t[:k] in stem_set for k in STEMS if k < len(t))}
    kept = {t: (True, found[t, True]) for t in stem_set}
    for (t, stem), odds in found.items():
        if not stem and not any(t[:k] in stem_set for k in STEMS):
            kept[t] = (False, odds)
    return kept


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, never_less: int = 3) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the ridge spares the intercept.

    The first ``never_less`` features are counts of hits. One that gets a negative weight is left out and the rest are
    fitted anew: a hit, misspelled or not, never makes a text look milder.
    """
    used = list(range(x.shape[1]))
    while True:
        z = np.hstack([np.ones((len(x), 1)), x[:, used]])
        w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
        penalty[0, 0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        bad = [k for k, v in zip(used, w[1:]) if k < never_less and v < 0]
        if not bad:
            full = dict(zip(used, w[1:].tolist()))
            return (float(w[0]), *[full.get(k, 0.0) for k in range(x.shape[1])])
        used = [k for k in used if k not in bad]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Learns the lexicon, and the weights of the features on rows measured with lexicons that were learned without them.

    ``labels`` has doc_id and toxic (1 or 0; null: no label; the larger of two counts). Rows whose crc32(doc_id as text)
    is divisible by 5 are never learned from. Without both labels, nothing is learned and every text scores below 0.5.
    """
    sample = cut(train_rows(docs, labels, key, text, rows))
    *folds, whole = [Model(terms) for terms in learn_terms(sample)]
    if not whole.terms:
        return whole
    seen = sample.sortWithinPartitions("fold").mapInArrow(_featured(folds), f"y double, fold int, {_FEATURES}").drop("fold").collect()
    if len({r["y"] for r in seen}) == 2:
        data = np.array(seen, dtype=float)
        whole.weights = fit_weights(data[:, 1:], data[:, 0])
    return whole


_FEATURES = ", ".join(f"f{k} double" for k in range(6))


def _featured(models: list[Model]):
    """Batches of (text, a column to carry, number of the model) to the latter two and the features.

    One model's automaton is held at a time, so rows should come in the order of their models.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        at, find = None, None
        for b in slices(batches, 0):
            which = b.column(2).to_numpy()
            values = np.zeros((b.num_rows, 6))
            for v in np.unique(which).tolist():
                if v != at:
                    find = None  # the last model's automaton goes before the next one's grows
                    at, find = v, matcher(models[v])
                mine = np.flatnonzero(which == v)
                values[mine] = features(b.column(0).take(pa.array(mine)), find, models[v])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *[pa.array(values[:, k]) for k in range(6)]], [*b.schema.names[1:], *[f"f{k}" for k in range(6)]])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, from its whole text alone; a null text is the empty one.

    No shuffle; repeated rows stay; other columns aren't read; an empty table gives an empty result.
    """
    body = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).alias("doc_id"), F.lit(0).alias("model"))
    seen = body.mapInArrow(_featured([model]), f"doc_id {docs.schema[key].dataType.simpleString()}, model int, {_FEATURES}")
    z = F.lit(model.weights[0])
    for k, w in enumerate(model.weights[1:]):
        z = z + F.lit(w) * F.col(f"f{k}")
    return seen.select("doc_id", (1 / (1 + F.exp(-z))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, by a model of the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
