"""Embedding near-dedup by lattice hashing.

A unit vector is projected at random to `blocks` times eight dimensions and each eight are decoded to the nearest point
of the E8 lattice, the densest packing there, whose cells are as round as eight dimensions allow. A table's key is the
points of all its blocks; the `probes` next nearest points of each block are probed too, and two vectors are candidates
if any of their keys are the same in some table. With the defaults 12 tables of four keys find a pair of cosine 0.9 with
a chance of 97 %, one of 0.95 of 99.9 %, and one pair of unrelated vectors in some ten thousand; all candidates are then
decided by their cosine in double precision.

Equal vectors are one node from the start, so copies form no pairs. Keys are first counted, and those of one node go;
only ids and keys take part in that. A key's nodes meet in blocks of at most about `block` nodes, so a cell with a third
of all vectors is many tasks' work. No pairs are put out: a pair that several keys find is counted where the first of
their common keys is at hand, each node gets the number of its links, and the links themselves are thinned out to a
forest that joins the same nodes.

Cases: null and zero vectors and those with null or non-finite components link with nothing; vectors of different lengths
do not either; repeated rows are copies; rows that share an id keep a vector each; null ids take part but are never the
smallest unless alone; an empty table gives an empty result; other columns are not read. Vectors are taken for equal
if their components' SHA-256 digests are.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, lean, scratch
from .components import components
from .spelling_variants import _whole_runs

COSINE = 0.9
TABLES, BLOCKS, PROBES, WIDTH, SEED = 12, 2, 1, 1.8, 1
BLOCK = 1024
#: A key's low bits name its table. Groups of up to SMALL nodes are compared many at once, by PAIRS pairs.
MOST_TABLES = 64
SMALL, PAIRS = 64, 1 << 17


def _minimal() -> np.ndarray:
    """The 240 shortest points of E8: what lies next to a lattice point."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = _minimal()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: if the sum is odd, the coordinate nearest to a half goes the
    other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    off = x[odd] - r[odd]
    at = np.abs(off).argmax(axis=1)
    r[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1.0, -1.0)
    return r


def decoded(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: even ones, or even ones moved by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """Twice the coordinates of each row's own point and of the next nearest ones: whole numbers, rows x (1 + probes) x 8."""
    home = decoded(x)
    toward = (x - home) @ NEIGHBOURS.T  # all neighbours are equally long
    got = [home]
    for _ in range(probes):
        best = toward.argmax(axis=1)
        got.append(home + NEIGHBOURS[best])
        toward[np.arange(len(x)), best] = -np.inf
    return np.rint(2 * np.stack(got, axis=1)).astype(np.int64)


@functools.cache
def _projections(size: int, tables: int, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed)
    return r.standard_normal((tables, blocks, size, 8)), r.randint(1, 1 << 62, size=(tables, blocks, 8), dtype=np.int64) | 1


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither under- nor overflows below
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def table_keys(u: np.ndarray, table: int, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Keys of unit vectors in one table: rows x (1 + probes)^blocks, as 64-bit numbers that end in the table's. A key
    stands for the table, the vectors' length and the lattice points; should two ever share one, the cosine still decides."""
    n, size = u.shape
    planes, factors = _projections(size, tables, blocks, seed)
    got = np.full((n, 1), (table + 1) * 0x51ED270B + size, dtype=np.int64)
    for b in range(blocks):
        of = (cells(u @ planes[table, b] / width, probes) * factors[table, b]).sum(axis=2)
        got = (got[:, :, None] * np.int64(0x5851F42D4C957F2D) + of[:, None, :]).reshape(n, -1)
    got ^= (got >> 29) & 0x7FFFFFFFF
    return (got & ~np.int64(MOST_TABLES - 1)) | table


def keys(u: np.ndarray, tables: int = TABLES, **how) -> np.ndarray:
    """Keys of unit vectors in all tables: rows x tables x (1 + probes)^blocks."""
    if tables > MOST_TABLES:
        raise ValueError(f"at most {MOST_TABLES} tables")
    return np.stack([table_keys(u, t, tables, **how) for t in range(tables)], axis=1)


def scaled(width: float, cosine: float) -> float:
    """The width that finds pairs of another cosine with the same chance."""
    return width * ((1 - cosine) / (1 - COSINE)) ** 0.5


def distinct_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, digest (null for vectors that link with nothing), vec (components as doubles in bytes)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            x = pc.fill_null(b.column(1).flatten(), float("nan")).to_numpy(zero_copy_only=False) + 0.0  # no -0.0
            end = np.cumsum(size)
            digests, vectors = [], []
            for s, e in zip((end - size).tolist(), end.tolist(), strict=True):
                v = x[s:e]
                if e > s and np.isfinite(v).all() and v.any():
                    vectors.append(v.tobytes())
                    digests.append(hashlib.sha256(vectors[-1]).digest())
                else:
                    vectors.append(None)
                    digests.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "digest", "vec"])

    d = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return d.mapInArrow(lean(read), f"vec_id {d.schema['vec_id'].dataType.simpleString()}, digest binary, vec binary")


def _units(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each length in a column of bytes."""
    raw = column.to_pylist()
    size = np.array([len(v) for v in raw])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, unit(np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1))


def joined(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest that joins what the links (i, j) between n places join."""
    near = np.zeros((n, n), dtype=bool)
    near[i, j] = near[j, i] = True
    out, seen = [], np.zeros(n, dtype=bool)
    for start in np.unique(i):
        if seen[start]:
            continue
        seen[start], front = True, [int(start)]
        while front:
            at = front.pop()
            fresh = np.flatnonzero(near[at] & ~seen)
            seen[fresh] = True
            out += [(at, int(x)) for x in fresh]
            front += fresh.tolist()
    return out


def counted_here(u: np.ndarray, i: np.ndarray, j: np.ndarray, key: np.ndarray, **how) -> np.ndarray:
    """Of pairs of rows, each found by a key, those whose first common key that is: no earlier table has one, nor this
    table a smaller one. Tables are looked at in turn, and only for pairs that are left."""
    table, ok = key & (MOST_TABLES - 1), np.ones(len(i), dtype=bool)
    for t in range(int(table.max(initial=-1)) + 1):
        todo = np.flatnonzero(ok & (table >= t))
        if not len(todo):
            continue
        rows, at = np.unique(np.concatenate([i[todo], j[todo]]), return_inverse=True)
        own = table_keys(u[rows], t, **how)
        a, b = own[at[: len(todo)]], own[at[len(todo) :]]
        same = (a[:, :, None] == b[:, None, :]).any(axis=2)
        low = np.where(same, a, np.iinfo(np.int64).max).min(axis=1)
        ok[todo] = np.where(table[todo] == t, low == key[todo], ~same.any(axis=1))
    return ok


def near_pairs(u: np.ndarray, bounds: np.ndarray, side: np.ndarray, alone: np.ndarray, cosine: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (between bounds) with at least that cosine, some at a time. The rows of a group that is
    not `alone` are of two blocks (sides 0 and 1), and only pairs across are asked for."""
    begin, size = bounds[:-1], np.diff(bounds)
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    work = np.cumsum(size[small] * (size[small] - 1) // 2)
    for part in np.split(small, np.flatnonzero(np.diff(work // PAIRS)) + 1) if len(small) else []:
        later = np.concatenate([np.arange(n - 1, -1, -1) for n in size[part]])  # rows of the group after each row
        row = np.concatenate([np.arange(s, s + n) for s, n in zip(begin[part], size[part], strict=True)])
        across = np.repeat(~alone[part], size[part])
        i = np.repeat(row, later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        if across.any():
            ask = ~np.repeat(across, later) | (side[i] != side[j])
            i, j = i[ask], j[ask]
        ok = np.einsum("ij,ij->i", u[i], u[j]) >= cosine
        yield i[ok], j[ok]
    for g in np.flatnonzero(size > SMALL):
        rows = np.arange(begin[g], begin[g] + size[g])
        one, two = (rows, rows) if alone[g] else (rows[side[rows] == 0], rows[side[rows] == 1])
        for p in range(0, len(one), step):
            for q in range(p if alone[g] else 0, len(two), step):
                r, c = one[p : p + step], two[q : q + step]
                near = u[r] @ u[c].T >= cosine
                if alone[g]:
                    near &= r[:, None] < c[None, :]
                i, j = np.nonzero(near)
                yield r[i], c[j]


def group_links(u: np.ndarray, key: np.ndarray, bounds: np.ndarray, side: np.ndarray, alone: np.ndarray, copies: np.ndarray, cosine: float, **how) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links counted here of each row, edges between rows that join what these links join)."""
    count, edges = np.zeros(len(u), dtype=np.int64), []
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for i, j in near_pairs(u, bounds, side, alone, cosine):
        ok = counted_here(u, i, j, key[i], **how)
        i, j = i[ok], j[ok]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        order = np.argsort(of[i], kind="stable")
        i, j = i[order], j[order]
        for part_i, part_j in zip(np.split(i, cuts := np.flatnonzero(np.diff(of[i])) + 1), np.split(j, cuts), strict=True):
            rows, at = np.unique(np.concatenate([part_i, part_j]), return_inverse=True)
            if len(part_i) < len(rows):
                edges += zip(part_i.tolist(), part_j.tolist(), strict=True)
            else:
                n = len(part_i)
                edges += [(int(rows[x]), int(rows[y])) for x, y in joined(len(rows), at[:n], at[n:])]
    return count, edges


def links(nodes: DataFrame, cosine: float = COSINE, tables: int = TABLES, block: int = BLOCK, **how) -> DataFrame:
    """Rows (a, b, null), links that join all linked nodes, and (a, null, n), links of node a counted in one place.
    nodes: id, copies, vec."""
    import pyarrow as pa

    width = scaled(how.pop("width", WIDTH), cosine)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, u in _units(b.column(1)):
                k = np.sort(keys(u, tables, width=width, **how).reshape(len(at), -1), axis=1)
                fresh = np.ones(k.shape, dtype=bool)
                fresh[:, 1:] = k[:, 1:] != k[:, :-1]
                row, col = np.nonzero(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(k[row, col]), pa.array(ids[at[row]])], ["k", "id"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches):
            where = np.stack([t.column(c).to_numpy() for c in ("run", "k", "i", "j")])
            order = np.lexsort(where[::-1])  # a run is a hash of (key, block, block): rows are told apart by these themselves
            ids, copies, side = (t.column(c).to_numpy()[order] for c in ("id", "copies", "side"))
            where = where[:, order]
            for at, u in _units(t.column("vec").take(pa.array(order))):
                k, i, j = where[1:, at]
                first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
                count, edges = group_links(u, k, np.r_[first, len(at)], side[at], (i == j)[first], copies[at], cosine, tables=tables, width=width, **how)
                some, e = np.flatnonzero(count), np.array(edges, dtype=np.int64).reshape(-1, 2)
                a = pa.array(ids[at[np.concatenate([some, e[:, 0]])]])
                b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[at[e[:, 1]]])])
                n = pa.concat_arrays([pa.array(count[some]), pa.nulls(len(e), pa.int64())])
                yield pa.RecordBatch.from_arrays([a, b, n], ["a", "b", "n"])

    every = cut(nodes.select("id", "vec").mapInArrow(lean(keyed), "k long, id long"))
    sizes = every.groupBy("k").agg(F.count("*").alias("size")).filter("size > 1")
    live = join_hot(every, sizes, "k", "size", every.count())
    blocks = F.ceil(F.col("size") / block).cast("int")
    live = live.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id", "k"), F.col("blocks")).cast("int"))
    met = live.select("k", "id", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("k", "id", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    rows = met.join(nodes.hint("merge"), "id").withColumn("run", F.xxhash64("k", "i", "j"))
    rows = rows.select("run", "k", "i", "j", "side", "id", "copies", "vec").repartition("run").sortWithinPartitions("run")
    return rows.mapInArrow(lean(compared), "a long, b long, n long")


def near_dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, **how) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors with at least that cosine that the index finds) and
    component_id (the smallest id of all vectors reachable by links)."""
    spark = df.sparkSession
    with scratch(spark) as keep:
        rows = keep(distinct_rows(df, id_col, vec_col))
        nodes = rows.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        nodes = keep(nodes.repartition(tasks).select(F.monotonically_increasing_id().alias("id"), "digest", "low", "copies", "vec"))
        found = cut(links(nodes.select("id", "copies", "vec"), cosine, **how))
        of = nodes.select("id", "digest", "low", "copies")
        counts = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        linked = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "id")
        of = of.join(counts, "id", "left").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
        lows = of.groupBy("component").agg(F.min("low").alias("component_id"))
        of = cut(of.join(lows, "component").select("digest", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
        known = rows.filter("digest is not null").select("vec_id", "digest")
        out = join_hot(known, of, "digest", "copies", known.count()).select("vec_id", "n_links", "component_id")
        alone = rows.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return cut(out.unionByName(alone))


def op13_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
