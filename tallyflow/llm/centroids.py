"""Centroid clustering by annulus search, in exact integer arithmetic.

A vector's distance to a centroid is at least the difference of their norms. So once the distance to one centroid is known,
only centroids whose norm lies within that distance of the vector's norm, an annulus around the origin, can be as near.
Centroids are sorted by norm; the first guess is the one of the nearest norm, its exact distance is the upper bound, two
binary searches give the annulus' first and last centroid, and those between are compared exactly, ties on the boundary
included. Norms are floating point, so the annulus is widened by more than their rounding errors; distances are integers.

Vectors stay where they are read. A round sends one row of sums per centroid and slice, which are added before the shuffle;
the driver holds the centroids only, ``k`` vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import cut, table

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components of this size or less give squared distances that fit a long, as the result has them.
_MOST = 1 << 27
_STEP = 1 << 14


def whole_vectors(df: DataFrame, dims: int = DIMS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): vectors of exactly ``dims`` components, none null or non-finite, each component times ``scale``
    and floored. Other rows are left out; repeated rows stay.

    A component beyond 2^27 in size has no distance that fits a long and raises an error.
    """
    fit = F.size(vector) == dims
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    checked = F.when(F.exists(whole, lambda x: F.abs(x) > _MOST), F.raise_error(F.lit("a component is too large for distances in a long"))).otherwise(whole)
    return df.where(fit & finite).select(F.col(key).alias("vec_id"), checked.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors of the smallest SHA-256 of ``seed:id``, in that order, or all if there are fewer.

    Rows of one id follow their components; rows without an id are never centroids.
    """
    named = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [list(r["v"]) for r in named.orderBy("h", "v").limit(k).collect()]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each row's nearest centroid, the smaller number of equally near ones, and how many
    distances were worked out."""
    norm = np.sqrt((centroids.astype(float) ** 2).sum(1))
    order = np.argsort(norm, kind="stable")
    sorted_norm, c = norm[order], centroids[order]
    own = np.sqrt((x.astype(float) ** 2).sum(1))
    after = np.searchsorted(sorted_norm, own)
    left, right = np.maximum(after - 1, 0), np.minimum(after, len(c) - 1)
    guess = np.where(own - sorted_norm[left] <= sorted_norm[right] - own, left, right)
    distance = ((x - c[guess]) ** 2).sum(1)
    number, done = order[guess], len(x)
    slack = (own + sorted_norm[-1]) * 1e-9
    bound = np.sqrt(distance.astype(float)) * (1 + 1e-9) + slack
    first, last = np.searchsorted(sorted_norm, own - bound, "left"), np.searchsorted(sorted_norm, own + bound, "right")
    for step in range(1, len(c)):  # outward from the guess; the bound shrinks with every nearer centroid
        inside = False
        for j in (guess - step, guess + step):
            some = np.flatnonzero((first <= j) & (j < last))
            inside |= len(some) > 0
            some = some[np.abs(own[some] - sorted_norm[j[some]]) <= bound[some]]
            at = j[some]
            d = ((x[some] - c[at]) ** 2).sum(1)
            done += len(some)
            better = (d < distance[some]) | ((d == distance[some]) & (order[at] < number[some]))
            distance[some[better]], number[some[better]] = d[better], order[at[better]]
            bound[some[better]] = np.sqrt(d[better].astype(float)) * (1 + 1e-9) + slack[some[better]]
        if not inside:
            break
    return number, distance, done


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, _STEP) for b in batches for i in range(0, b.num_rows, _STEP))


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster int, distance long): each vector's nearest centroid and its squared distance."""
    c = np.array(centroids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            number, distance, _ = nearest(_matrix(b.column(1), c.shape[1]), c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floored mean of each one's vectors; one without vectors stays."""
    c = np.array(centroids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = _matrix(b.column(1), c.shape[1])
            number, _, _ = nearest(x, c)
            used = np.unique(number)
            sums = [x[number == j].sum(0) for j in used]
            counts = np.bincount(number, minlength=len(c))[used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    found = vectors.select("vec_id", "v").mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("dim", "x"))
    rows = found.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = [list(v) for v in centroids]
    for r in rows:
        out[r["cluster"]][r["dim"]] = int(r["x"]) // r["n"]
    return out


def clustered(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256) per kept vector.

    ``rounds`` of assignment and exact floored means from ``k`` first centroids, then a last assignment. Rounds end early
    where no centroid moves, as no later one could. Vectors that ``whole_vectors`` leaves out have no row, repeated rows
    one each, a null id a row like any other; an empty table gives an empty result. Other columns aren't read.
    """
    vectors = cut(whole_vectors(df, dims, scale, key, vector))
    centroids = first_centroids(vectors, k, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not centroids:
        if not vectors.isEmpty():
            raise ValueError("no vector has an id, so there are no first centroids")
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        after = moved(vectors, centroids)
        if after == centroids:
            break
        centroids = after
    found = cut(assign(vectors, centroids))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = [(j, s, sum(sums.values()), digest[j]) for j, s in sorted(sums.items())]
    named = vectors.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all whole vectors of ``embeddings`` after ten rounds.

    Vectors of another length, with a null or a non-finite component have no row; null embeddings neither.
    """
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
 FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT r, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v)",
        f"first AS (SELECT e, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), e) - 1 AS k FROM v WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), e) <= {k})",
        "c0 AS MATERIALIZED (SELECT k, unnest(e) AS c, generate_subscripts(e, 1) AS d FROM first)",
    ]
    near = "SELECT r, k, distance FROM (SELECT r, k, sum((x - c) * (x - c)) AS distance FROM x JOIN c{i} USING (d) GROUP BY r, k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1"
    for i in range(rounds):
        ctes.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        ctes.append(f"""m{i} AS (SELECT k, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY k, d)""")
        ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.k, c.d, CASE WHEN n IS NULL THEN c.c ELSE s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END END AS c FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k AND c.d = m.d)""")
    ctes.append(f"a AS MATERIALIZED ({near.format(i=rounds)})")
    ctes.append(f"h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return f"""WITH {", ".join(ctes)}
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
 CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a JOIN v USING (r) JOIN h USING (k)"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLE_SQL: dict[str, str] = {"op13_centroid_clustering": _sql()}
