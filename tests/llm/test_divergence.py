"""The divergence audit against plain sums."""

import random
import re
from collections import Counter, defaultdict

from tallyflow.llm import divergence

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERMS.findall((text or "").translate(lower))
        count[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= least}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (g, s), c in count.items() if g == lang}
        every = sum((Counter(c) for c in groups.values()), Counter())
        p = lambda c: {t: 1 + 10**9 * (c.get(t, 0) + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in groups.items()}, p(every)
        for s, own in shares.items():
            pairs = [(-sum(abs(own[t] - o[t]) for t in kept), x) for x, o in shares.items() if x != s]
            terms = [(q[t] - own[t], t) for t in groups[s] if own[t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda r: (r[0], r[1].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(ranked)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).collect())


def test_tiles_of_every_size(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Ünï", "ünï", "日本", "É", "é", "ABC", "abc"]
    rows = [(" ".join(rng.choice(words[: rng.choice((20, 100, 307))]) for _ in range(rng.randrange(60))), rng.choice(("en", "en", "de", None)), f"s{rng.randrange(12)}") for _ in range(600)]
    rows += [(None, "en", "s1"), ("", "fr", "a"), ("once only", "fr", "b"), (None, None, None), ("1 2 3 --", "", ""), ("a_b-c'd\x00e{f}~\x7f" * 50, "en", "quiet")]
    rows += [("same row", "en", "s1")] * 40
    df = spark.createDataFrame([(t, g, s, 1, "x") for t, g, s in rows], "text string, lang string, source string, n int, term string").repartition(3)
    want = brute(rows, 4, 7)
    assert {r[0] for r in want if r[2] == "pair" and r[4] == 0} >= {"fr"}  # no kept terms
    for chunk, span, block in ((4096, 16, 32), (16, 2, 3), (1, 1, 1), (50, 100, 5)):
        assert got(df, least_docs=4, top=7, chunk=chunk, span=span, block=block) == want
    assert got(df.limit(0)) == []
    assert got(df.where("lang = 'fr' and source = 'a'")) == []  # one group, no terms


def test_large_counts_are_exact(spark):
    import numpy as np

    rng = random.Random(1)
    total = 9_000_000_000_000_000
    n = [0, 1, total // 3, *(rng.randrange(total // 7) for _ in range(50))]
    want = [1 + 10**9 * (x + 5) // total for x in n]
    assert divergence._shares(np.array(n), total, 5).tolist() == want
    df = spark.createDataFrame([(x, total - 5 * 40, 40) for x in n], "n long, t long, v long").select(divergence.share("n", "t", "v").alias("p"))
    assert [r["p"] for r in df.collect()] == want
