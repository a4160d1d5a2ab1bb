"""SimHash near-duplicates against all pairs, and the shared component search."""

import random
import re

import xxhash

from tallyflow.llm import simhash
from tallyflow.llm.common import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(t):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints, distance=4):
    top = {i: i for i, _ in prints}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: find(i) for i in top}


def check(df):
    rows = [(r["doc_id"], brute_print(r["text"])) for r in df.collect()]
    got = {r["doc_id"]: (r["fingerprint"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    want = brute_components(rows)
    assert got == {i: (f, want[i]) for i, f in rows}


def test_against_all_pairs(spark, data):
    check(spark.read.parquet(f"{data}/documents.parquet"))


def test_clouds_and_odd_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(300)]
    texts = [None, "", " \n", "one", "One", "a b c", "é ü", "x " * 5000]
    for _ in range(250):
        t = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i * 3, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, cell int")
    check(df)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(3)
    rows = [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(500)] + [(-1, 0), (5, 5)]
    df = spark.createDataFrame(rows, "a long, b long")
    for r in df.select("a", "b", simhash.manhattan("a", "b").alias("m"), simhash.hamming("a", "b").alias("h")).collect():
        a, b = r["a"] % 2**64, r["b"] % 2**64
        want = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert r["m"] == want <= r["h"] == (a ^ b).bit_count()


def test_cells_cover_every_pair_within_reach():
    rng = random.Random(4)
    pop = lambda f: sum((f >> s & 3).bit_count() << s for s in range(0, 64, 2))
    masks = [m % 2**64 for m in simhash.cells(4, 7)]
    for _ in range(2000):
        a = b = rng.getrandbits(64)
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        assert any(pop(a) & m == pop(b) & m for m in masks)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 640)] + [(1000, k) for k in range(1001, 1200)]
    top = {}

    def find(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in top if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
