"""Centroid clustering in exact integers: fast float32 products screen, exact distances decide.

A vector's squared distance to centroid c, less the vector's own square, is |c|^2 - 2 x.c. For a batch of vectors and all centroids x.c
is one float32 matrix product. Its error is bounded whatever the order in which the products are summed: with u = 2^-24 each input is
rounded by a factor within 1 +- u and a sum of n products by n u / (1 - n u) of the sum of their absolute values, which is |x| |c| at most.
So each distance lies in a known interval. A centroid whose interval begins after another's end can't be the nearest; where one
is left it is the nearest, and where more are left their exact distances decide, ties by the lower number.

Components are whole numbers. They are kept as doubles, which hold floor(scale * x) exactly whatever its size, and are counted in 64 bits
where their size allows, else in Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored, table

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Up to this size squared distances of up to 2^8 components fit 64 bits, and sums of a batch are exact in doubles.
_SMALL = float(1 << 26)
_LIMB = 32  # sums travel in limbs of so many bits, each with the sum's sign, so that they can grow to any size
_LONG = (1 << 63) - 1
BATCH = 4096
_U, _EPS = 2.0**-24, 2.0**-52


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(_id, _v array<double>): vectors of `dim` components, none null or non-finite, as floor(scale * x).

    A double that is no longer finite when scaled counts as non-finite.
    """
    v = quoted(vec_col).cast("array<double>")
    fits = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x * F.lit(float(scale))) < F.lit(float("inf"))))
    rows = df.select(quoted(id_col).alias("_id"), v.alias("_v")).where(F.coalesce(fits, F.lit(False)))

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.floor(b.column(1).flatten().to_numpy() * scale)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, len(got) + 1, dim, dtype=np.int32), got)], ["_id", "_v"])

    return rows.mapInArrow(floored, rows.schema)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of the smallest sha256 of `<seed>:<id>`; null ids come last, and of one id the smaller components first."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("_k"), "_v").orderBy(F.col("_k").asc_nulls_last(), "_v").limit(k).collect()
    return [[int(x) for x in r["_v"]] for r in rows]


class Screen:
    """Nearest centroids of batches of whole-number vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.c64 = np.array([[float(x) for x in c] for c in centroids])
        with np.errstate(over="ignore", invalid="ignore"):
            self.c32 = self.c64.astype(np.float32).T.copy()
            self.square = np.array([float(sum(x * x for x in c)) if max(map(abs, c)) < 1 << 500 else np.inf for c in centroids])
        self.norm = np.sqrt(self.square)
        self.small = bool((np.abs(self.c64) <= _SMALL).all()) and len(centroids[0]) <= 256
        self.c_int = self.c64.astype(np.int64) if self.small else None

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of |c|^2 - 2 x.c; NaN where float32 gives none."""
        n = x.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            dot = (x.astype(np.float32) @ self.c32).astype(np.float64)
            # rounding of the inputs and of n products and sums, of |x| |c| at most; the norms themselves are doubles
            rel = (n * _U / (1 - n * _U) * (1 + _U) ** 2 + 2 * _U + _U * _U) * (1 + 1e-6)
            size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * self.norm
            mid = self.square - 2 * dot
            err = 2 * rel * size + 4 * _EPS * (self.square + 2 * np.abs(dot))
            return mid - err, mid + err

    def _distance(self, row: list[int], c: int) -> int:
        return sum((a - b) ** 2 for a, b in zip(row, self.exact[c], strict=True))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray, int]:
        """(cluster, exact squared distance, vectors that the screen left open) of each row of x."""
        low, high = self.intervals(x)
        finite = np.isfinite(low).all(1) & np.isfinite(high).all(1)
        left = (low <= np.where(finite, high.min(1), np.inf)[:, None]) | ~finite[:, None]
        best = left.argmax(1)
        open_rows = np.flatnonzero(left.sum(1) > 1)
        small = self.small & (np.abs(x) <= _SMALL).all(1)
        ints = x[small].astype(np.int64)
        at = np.cumsum(small) - 1
        easy = open_rows[small[open_rows]]
        if len(easy):  # exact distances of the pairs that are left, in order of vector and centroid: the first smallest wins
            r, c = np.nonzero(left[easy])
            gap = ints[at[easy]][r] - self.c_int[c]
            d = np.einsum("ij,ij->i", gap, gap)
            order = np.lexsort((c, d, r))
            first = np.unique(r[order], return_index=True)[1]
            best[easy] = c[order][first]
        for i in open_rows[~small[open_rows]]:
            row = [int(v) for v in x[i]]
            best[i] = min((self._distance(row, c), c) for c in np.flatnonzero(left[i]))[1]
        if small.all():
            gap = ints - self.c_int[best]
            return best, np.einsum("ij,ij->i", gap, gap), len(open_rows)
        return best, [self._distance([int(v) for v in row], c) for row, c in zip(x, best, strict=True)], len(open_rows)


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, BATCH):
            part = b.slice(i, BATCH)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(-1, dim)


def _cluster_sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, sums of components)}; k * (dim + 1) numbers reach the driver, however many vectors there are."""
    dim = len(centroids[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, k = Screen(centroids), len(centroids)
        count, total = np.zeros(k, np.int64), [[0] * dim for _ in range(k)]
        for _, x in _batches(batches, dim):
            best, _, _ = screen.nearest(x)
            count += np.bincount(best, minlength=k)
            if np.abs(x).max(initial=0) <= _SMALL:
                member = np.zeros((k, len(x)))
                member[best, np.arange(len(x))] = 1
                for c, row in enumerate(member @ x):
                    if row.any():
                        total[c] = [a + int(b) for a, b in zip(total[c], row, strict=True)]
            else:
                for c, row in zip(best, x, strict=True):
                    total[c] = [a + int(b) for a, b in zip(total[c], row, strict=True)]
        out = []
        for c in np.flatnonzero(count):
            for at, s in enumerate([int(count[c]), *total[c]]):
                sign, s, limb = (-1 if s < 0 else 1), abs(s), 0
                while s:
                    out.append((int(c), at, limb, sign * (s & ((1 << _LIMB) - 1))))
                    s, limb = s >> _LIMB, limb + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "at", "limb", "s"])

    rows = vectors.mapInArrow(partial, "cluster int, at int, limb int, s long").groupBy("cluster", "at", "limb").agg(F.sum("s").alias("s")).collect()
    found: dict[int, list[int]] = {}
    for r in rows:
        found.setdefault(r["cluster"], [0] * (dim + 1))[r["at"]] += r["s"] << (_LIMB * r["limb"])
    return {c: (v[0], v[1:]) for c, v in found.items()}


def cluster(df: DataFrame, id_col: str, vec_col: str, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance), final centroids): a row for each vector of `dim` finite components, repeated rows and null ids included.

    Each of the rounds assigns all vectors and moves each centroid that has vectors to the exact floor of their mean; then they are assigned
    once more. Fewer vectors than k make fewer centroids, none at all an empty result. A distance that no long holds is null. Other columns are not looked at.
    The vectors are stored once in the shared folder; a round reads them, and only sums of each task are shuffled.
    """
    vectors = stored(kept_vectors(df, id_col, vec_col, dim, scale))
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        for c, (n, total) in _cluster_sums(vectors, centroids).items():
            centroids[c] = [s // n for s in total]
    kind = dict(vectors.dtypes)["_id"]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids) if centroids else None  # no centroids, no vectors
        for ids, x in _batches(batches, dim):
            best, d, _ = screen.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array([v if v <= _LONG else None for v in d] if isinstance(d, list) else d, pa.int64())], ["_id", "cluster", "distance"])

    return vectors.mapInArrow(assigned, f"_id {kind}, cluster int, distance long").withColumnRenamed("_id", id_col), centroids


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows with cluster_inertia, inertia (distance summed over the cluster and over all; null where no long holds it) and centroid_sha256."""
    spark, rows = rows.sparkSession, stored(rows)
    got = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    sums = {r["cluster"]: None if r["lost"] else int(r["s"]) for r in got}
    fits = lambda s: s if s is not None and s <= _LONG else None
    total = None if None in sums.values() else sum(sums.values())
    of = [(c, fits(s), fits(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    sums = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(sums), "cluster")  # a row for each centroid


def op11(spark, sf_dir):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector; odd vectors as in `cluster`."""
    rows, centroids = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return with_inertia(rows, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql() -> str:
    d2 = f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: (x[i] - m[i]) * (x[i] - m[i])))"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        f"WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM})",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) - 1 AS c, x AS m FROM v QUALIFY c < {CENTROIDS})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT n, vec_id, x, c, d FROM (SELECT n, vec_id, x, c, {d2} AS d FROM v, m{r}) QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1)")
        if r < ROUNDS:
            steps += [
                f"s{r} AS (SELECT c, i, sum(y) AS s, count(*) AS k FROM (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i)",
                f"m{r + 1} AS MATERIALIZED (SELECT m{r}.c, coalesce(w, m) AS m FROM m{r} LEFT JOIN (SELECT c, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS w FROM s{r} GROUP BY c) AS w{r} ON m{r}.c = w{r}.c)",
            ]
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(a{ROUNDS}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{ROUNDS}.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN m{ROUNDS} ON a{ROUNDS}.c = m{ROUNDS}.c"
    )


OP11_SQL = _op11_sql()
