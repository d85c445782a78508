"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has 64 bits. With radius r every bit is given a nonzero vector of r + 1 bits; table t (also such a
vector) keeps the bits whose vector has an odd product with t. For any r differing bits some t has an even product
with all of them, so two fingerprints within the radius agree on all bits that table keeps: they collide in a table
for certain, not with some probability. For r = 3 that is 15 tables of 34 kept bits.

Documents with one fingerprint are one node from the start, so copies never form pairs. A bucket of up to `dense`
fingerprints is compared in blocks and gives a spanning forest of its links, not the pairs. A larger bucket is passed
on whole to a second covering family, in which its pairs collide again: the two families leave at most 20 bits free,
and with a third at most 14, so that a bucket cannot be larger than 2^14. No candidate is dropped.

Cases: null, empty and blank texts have fingerprint 0 and are linked like any other; texts of fewer words than a
shingle hash the whole sequence; very long texts are hashed in slices; a repeated id is one node; null ids take part
in links but are never the smallest unless alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import WORD, cut, documents, join_hot, lean
from .components import components

SEED = 42
BITS = 64
SLICE = 1 << 16  # hashes that are unpacked to bits at once


def fingerprint(text: str | None, width: int = 3) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= width:
        return digest(join(words), SEED)
    shingles = zip(*[words[i:] for i in range(width)], strict=False)
    hashes = np.fromiter((digest(join(s), SEED) for s in shingles), dtype="<u8", count=len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), SLICE):
        part = hashes[i : i + SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """One row per input row: doc_id and fp, the fingerprint as a signed long."""
    import pyarrow as pa

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([signed(fingerprint(t.as_py(), width)) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    d = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(lean(hashed), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int, family: int = 0) -> list[int]:
    """The masks of one covering family; families differ in the order in which bits get their vectors."""
    n = (1 << radius + 1) - 1
    order = np.random.RandomState(family).permutation(BITS) if family else np.arange(BITS)
    vector = {int(bit): 1 + i % n for i, bit in enumerate(order)}
    return [sum(1 << bit for bit, v in vector.items() if bin(v & t).count("1") % 2) for t in range(1, n + 1)]


def forest(fps: np.ndarray, radius: int, block: int = 512) -> Iterator[tuple[int, int]]:
    """Links that join exactly what the links within the radius join: at most len(fps) - 1 of them."""
    n = len(fps)
    root = np.arange(n)
    for i in range(0, n, block):
        for j in range(i, n, block):
            x = fps[i : i + block, None] ^ fps[None, j : j + block]
            near = np.bitwise_count(x) <= radius
            for p in np.flatnonzero(near.any(axis=1)):
                at = np.flatnonzero(near[p]) + j
                others, first = np.unique(root[at], return_index=True)
                for other, k in zip(others, first, strict=True):
                    if other != root[i + p]:
                        yield int(fps[i + p]), int(fps[at[k]])
                        root[root == other] = root[i + p]


def bucket_links(buckets: DataFrame, radius: int, dense: int) -> DataFrame:
    """buckets: key (of a table and its kept bits, as columns k*), fp. Rows (a, b, null) are links; rows of buckets of
    more than `dense` fingerprints come back as (fp, null, key)."""
    import pyarrow as pa

    names = ["a", "b", "k"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, spilt = None, [], False

        def settle() -> list[tuple]:
            if spilt or len(held) < 2:
                return []
            fps = np.array(held, dtype=np.int64).view(np.uint64)
            return [(signed(a), signed(b), None) for a, b in forest(fps, radius)]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names)

        for batch in batches:
            out = []
            for k, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    out += settle()
                    key, held, spilt = k, [], False
                if spilt:
                    out.append((fp, None, k))
                    continue
                held.append(fp)
                if dense and len(held) > dense:
                    out += [(x, None, k) for x in held]
                    held, spilt = [], True
            yield packed(out)
        yield packed(settle())

    # the 64-bit key stands for (table, kept bits): should two keys ever share it, forest still compares in full
    return buckets.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(lean(linked), "a long, b long, k long")


def links_within(fps: DataFrame, radius: int = 3, dense: int = 2048) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all pairs within the radius."""
    todo, out = fps.select(F.lit(0).cast("long").alias("k0"), "fp"), None
    for family in range(3):
        masks = F.array(*[F.lit(signed(m)) for m in covering_masks(radius, family)])
        t = todo.select("k0", "fp", F.posexplode(masks).alias("table", "mask"))
        t = t.select(F.xxhash64("k0", "table", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), "fp").distinct()
        got = cut(bucket_links(t, radius, dense if family < 2 else 0))
        found = got.filter("b is not null").select("a", "b")
        out = found if out is None else out.unionByName(found)
        rest = got.filter("b is null")
        if rest.isEmpty():
            break
        todo = rest.select(F.col("k").alias("k0"), F.col("a").alias("fp"))
    return out


def near_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = 3, width: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest id of all documents reachable by links)."""
    docs = cut(fingerprints(df, text_col, id_col, width))
    nodes = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    linked = components(links_within(nodes, radius))
    of = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = cut(of.join(lows, "component").select("fp", "n", "component_id"))
    return join_hot(docs, of, "fp", "n", docs.count()).select("doc_id", "fp", "component_id")


def candidates(texts: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """texts: node, text. Rows (k, node), once each: nodes with one k are connected by fingerprints within the radius. Texts
    without a word have no shingles to compare and are left out."""
    found = near_dedup(texts.filter(F.col("text").rlike(WORD)), "text", "node", radius, width)
    return found.select(F.xxhash64("component_id", F.lit("fp")).alias("k"), F.col("doc_id").alias("node")).distinct()


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = 3, width: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of df whose id is the smallest of its component, with all their columns.

    Components are those of fingerprints within the radius. If a similarity is given, these are candidates: all texts of a
    component are compared, and linked if their 5-word shingles have that Jaccard similarity. As no radius with a feasible
    covering family finds all pairs that have it, candidates that fingerprints miss are added (see near_copies)."""
    if similarity is not None:
        return near_copies.keep_one(df, text_col, id_col, similarity, lambda texts: candidates(texts, radius, width))
    found = near_dedup(df, text_col, id_col, radius, width).filter("doc_id <=> component_id")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    return rows.join(found.select("doc_id").distinct(), F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
