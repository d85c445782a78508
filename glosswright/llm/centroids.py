"""Centroid clustering on whole numbers, with block-norm screening.

Vectors become integers once, and are stored beside a compressed form: the sum of each of `segments` segments and the
norm of what the segment has beyond its mean. By Cauchy and Schwarz two segments are at least as far apart as their
means and those norms: (difference of sums)^2 / length + (difference of norms)^2. Summed up, that bounds the distance to
a centroid from below; the centroid of the smallest bound is measured first, and only those whose bound does not exceed
that distance are measured exactly. Screening never decides a comparison, so the result is that of measuring all.

A round is one pass over the stored table without a shuffle of vectors: a task adds its vectors up, and a row for each
cluster and component meets. The driver holds the centroids (k x components), nothing else.

Cases: vectors of another length, null ones and those with a null or non-finite component take no part; without any the
result is empty, and with fewer than k there are as many centroids; a null id has an empty decimal text and is kept;
of rows with one id the smaller vector stands first as a start; repeated vectors count each time; ties go to the smaller
number; components beyond 2^62 count as 2^62, and a distance or inertia that no long holds is the largest long (both are
compared exactly all the same). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, scratch

K, ROUNDS, SCALE, SEED = 8, 10, 1024, 3
SIZE, SEGMENTS = 64, 8
MOST = (1 << 63) - 1
#: Components up to this size have distances and sums that int64 holds; beyond, Python's whole numbers are used.
NARROW = 1 << 27


def compressed(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the segments, and the norms of what is left without their means; in double precision."""
    parts = x.astype(np.float64).reshape(len(x), segments, -1)
    sums = parts.sum(axis=2)
    rest = parts - sums[:, :, None] / parts.shape[2]
    return sums, np.sqrt((rest * rest).sum(axis=2))


def prepared(df: DataFrame, id_col: str, vec_col: str, size: int, scale: int, segments: int) -> DataFrame:
    """vec_id, v (whole numbers), s and r (compressed) of the vectors that take part."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if size % segments:
        raise ValueError("segments must divide the number of components")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = pc.equal(pc.list_value_length(b.column(1)), size)
            b = b.filter(fits)  # a null length drops the row
            if not b.num_rows:
                continue
            x = pc.fill_null(b.column(1).flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
            good = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(scale * x[good]), -(2.0**62), 2.0**62).astype(np.int64)
            sums, rest = compressed(v, segments)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), lists(v), lists(sums), lists(rest)], ["vec_id", "v", "s", "r"])

    d = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return d.mapInArrow(lean(whole), f"vec_id {d.schema['vec_id'].dataType.simpleString()}, v array<long>, s array<double>, r array<double>")


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, as whole numbers."""
    d = x - c
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, sums: np.ndarray, rest: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, how many distances were measured) of every row."""
    n, k = len(x), len(centroids)
    wide = max(abs(int(x.min())), abs(int(x.max())), max(abs(y) for c in centroids for y in c)) >= NARROW if n else False
    if wide:
        x, c = x.astype(object), np.array(centroids, dtype=object)
        d = np.stack([exact(x, c[j]) for j in range(k)], axis=1)
        a = np.array([min(range(k), key=row.__getitem__) for row in d], dtype=np.int64)
        return a, d[np.arange(n), a], n * k
    c = np.array(centroids, dtype=np.int64)
    c_sums, c_rest = compressed(c, sums.shape[1])
    length = x.shape[1] // sums.shape[1]
    apart = lambda p, q: ((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2)
    low = apart(sums, c_sums) / length + apart(rest, c_rest)
    norm = lambda s, r: (s * s).sum(axis=1) / length + (r * r).sum(axis=1)
    low -= 1e-11 * (norm(sums, rest)[:, None] + norm(c_sums, c_rest)[None, :]) + 1e-6  # beyond any rounding
    guess = low.argmin(axis=1)
    best = exact(x, c[guess])
    d = np.full((n, k), MOST, dtype=np.int64)
    d[np.arange(n), guess] = best
    open_ = low <= best[:, None]
    open_[np.arange(n), guess] = False
    row, col = np.nonzero(open_)
    d[row, col] = exact(x[row], c[col])
    a = d.argmin(axis=1)
    return a, d[np.arange(n), a], n + len(row)


def _arrays(b, columns: tuple[int, ...]) -> list[np.ndarray]:
    return [b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in columns]


def moved(table: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], int]:
    """The centroids after a round, and how many distances it measured."""
    import pyarrow as pa

    k, size = len(centroids), len(centroids[0])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, measured = [[0] * size for _ in range(k)], [0] * k, 0
        for b in batches:
            if not b.num_rows:
                continue
            x, s, r = _arrays(b, (0, 1, 2))
            a, _, m = nearest(x, s, r, centroids)
            measured += m
            if np.abs(x).max() >= NARROW:
                x = x.astype(object)
            for j in np.unique(a):
                mine = x[a == j]
                count[j] += len(mine)
                total[j] = [p + int(q) for p, q in zip(total[j], mine.sum(axis=0), strict=True)]
        rows = [(j, i, count[j], Decimal(total[j][i])) for j in range(k) if count[j] for i in range(size)] + [(-1, 0, measured, Decimal(0))]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], ["cluster", "i", "n", "total"])

    got = table.select("v", "s", "r").mapInArrow(lean(summed), "cluster int, i int, n long, total decimal(38,0)")
    rows = got.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # k x size
    out, measured = [list(c) for c in centroids], 0
    for row in rows:
        if row["cluster"] < 0:
            measured = row["n"]
        else:
            out[row["cluster"]][row["i"]] = int(row["total"]) // row["n"]
    return out, measured


def first_centroids(table: DataFrame, k: int, seed: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in table.select("v", order.alias("o")).orderBy("o", "v").limit(k).collect()]


def assigned(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance."""
    import pyarrow as pa

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, d, _ = nearest(*_arrays(b, (1, 2, 3)), centroids)
                if d.dtype == object:
                    d = np.array([min(x, MOST) for x in d], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(lean(placed), f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, size: int = SIZE, segments: int = SEGMENTS) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, cluster, distance) of every vector that takes part, the final centroids, and how many distances each round
    measured of rows times k."""
    spark = df.sparkSession
    with scratch(spark) as keep:
        table = keep(prepared(df, id_col, vec_col, size, scale, segments))
        centroids, measured = first_centroids(table, k, seed), []
        if not centroids:
            return cut(table.selectExpr("vec_id", "CAST(0 AS INT) AS cluster", "CAST(0 AS LONG) AS distance")), [], []
        for _ in range(rounds):
            centroids, m = moved(table, centroids)
            measured.append(m)
        return cut(assigned(table, centroids)), centroids, measured


def _long(c: Column) -> Column:
    return F.least(c, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids, _ = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of"))
    sha = spark.createDataFrame([(j, digest(c)) for j, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    every = sums.agg(F.sum("of").alias("all"))  # one row
    known = sums.join(F.broadcast(sha), "cluster").crossJoin(F.broadcast(every))  # k rows, one row
    known = known.select("cluster", _long(F.col("of")).alias("cluster_inertia"), _long(F.col("all")).alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
