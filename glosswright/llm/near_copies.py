"""Near-dedup by similarity: two texts are linked if the Jaccard similarity of their word shingles is at least 0.8.

This is what simhash.keep_one uses when it is given a similarity. Its candidates are texts linked by fingerprints, which come
in as `found`, and besides them those of MinHash: pairs of 0.8 or more differ in 4 to 14 of 64 bits on the 0.1 tables, and a
covering family of radius 14 has 32,767 tables (see the README).

In MinHash ROWS minima make a key, and each text has BANDS keys. Two texts of similarity s share a key with probability
1 - (1 - s ** ROWS) ** BANDS: at s = 0.8 one pair in 300,000 is missed, above it fewer. Every candidate of either kind is
then decided by the exact similarity of its whole shingle sets.

Texts that share a key (a bucket) belong to one cluster of candidates. A cluster is cut into blocks of about
`block_bytes`; the texts of a block meet in one task, once, and every pair of them is compared. A cluster of one block is
done then. In larger ones, all texts of a bucket with more than one component meet, in blocks, those outside its largest
component, again in blocks: every pair that could still join anything is compared, no task holds more than two blocks
and none hands on more rows than it has texts.

Cases: null and blank texts have no shingles and are linked to equal texts only; texts of fewer words than a shingle are
one shingle; equal texts are one node (told by 64-bit hashes); null ids take part in links but are never the smallest
unless alone; an empty table gives an empty result; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, lean, scratch, text_of
from .components import components

WIDTH, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 32
SEED = 42
SLICE = 1 << 12  # hashes that are permuted at once

#: Up to so many nodes (a number or two each) are broadcast; more meet their texts in a shuffle.
BROADCAST_NODES = 500_000

#: Bytes of text of a block: what one task compares in pairs.
BLOCK_BYTES = 1 << 20

_draw = np.random.RandomState(SEED)
_odd = lambda *shape: _draw.randint(0, 1 << 62, shape, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR, OFFSET, MIX, BAND = _odd(ROWS * BANDS), _odd(ROWS * BANDS), _odd(ROWS), _odd(BANDS)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*[islice(words, i, None) for i in range(width)], strict=False) if len(words) > width else [words]
    return np.unique(np.fromiter((digest(join(s), SEED) for s in runs), dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles; none for an empty one."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), SLICE):
        least = np.minimum(least, (hashes[i : i + SLICE, None] * FACTOR + OFFSET).min(axis=0))
    return ((least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) + BAND).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def signatures(df: DataFrame) -> DataFrame:
    """df: doc_id, node, text. One row per input row: doc_id, node, keys."""
    import pyarrow as pa

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([band_keys(shingles(t.as_py())) for t in b.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys], ["doc_id", "node", "keys"])

    return df.mapInArrow(lean(signed), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, node long, keys array<long>")


def joined(sets: list[np.ndarray], group: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Pairs (places in sets) of similar sets that join groups: at most one less than there are groups."""
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    flag, group = np.zeros(ids.max() + 1, np.int64), group.copy()
    for i in range(len(sets)):
        if (group == group[i]).all():
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        flag[own] = 1
        both = np.add.reduceat(flag[ids], starts)
        flag[own] = 0
        for j in np.flatnonzero(both / (sizes + sizes[i] - both) >= least):
            if group[j] != group[i]:
                yield i, int(j)
                group[group == group[j]] = group[i]


def candidate_texts(nodes: DataFrame, df: DataFrame) -> DataFrame:
    """nodes (node, cluster) with one text of each and its size; df: node, text."""
    few = nodes.count() <= BROADCAST_NODES
    texts = df.select("node", "text").join(F.broadcast(nodes) if few else nodes.hint("merge"), "node")
    return texts.groupBy("node", "cluster").agg(F.first("text").alias("text")).withColumn("size", F.octet_length("text"))


def linked_inside(rows: DataFrame, least: float) -> DataFrame:
    """Links a, b between components (c) inside each task t of rows (t, node, c, text): what joins them, never pairs."""
    import pyarrow as pa

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, groups, sets = None, [], [], []

        def settled() -> pa.RecordBatch:
            got = list(joined(sets, np.array(groups), least)) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in got], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for t, node, c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if t != key:
                    yield settled()
                    key, nodes, groups, sets = t, [], [], []
                nodes.append(node)
                groups.append(c)
                sets.append(shingles(x.as_py()))
        yield settled()

    rows = rows.select("t", "node", "c", "text").repartition("t").sortWithinPartitions("t", "node")
    return cut(rows.mapInArrow(lean(linked), "a long, b long"))


def blocks_of(bytes_: Column, block_bytes: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(bytes_ / block_bytes)).cast("int")


def links(docs: DataFrame, df: DataFrame, least: float, block_bytes: int = BLOCK_BYTES, found: DataFrame | None = None) -> DataFrame:
    """node, component for every node that is linked to another one; docs: node, keys; df: node, text; found: k, node,
    further candidates, which share a k."""
    rows = docs.select("node", "keys").dropDuplicates(["node"]).select(F.explode("keys").alias("k"), "node")
    rows = rows if found is None else rows.unionByName(found)
    buckets = rows.groupBy("k").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    members = cut(join_hot(rows, cut(buckets), "k", "n", rows.count()).select("k", "node", "lead"))
    of = components(members.filter("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")))
    with scratch(df.sparkSession) as keep:
        texts = keep(candidate_texts(of.withColumnRenamed("component", "cluster"), df))  # each candidate once
        clusters = cut(texts.groupBy("cluster").agg(blocks_of(F.sum("size"), block_bytes).alias("blocks"), F.count("*").alias("n")))
        # dealt by (cluster, block): a large cluster's key is spread before it is joined with its texts
        sized = join_hot(texts, clusters, "cluster", "n", texts.count())
        block = F.pmod(F.xxhash64("node"), F.col("blocks"))
        inside = linked_inside(sized.select(F.xxhash64("cluster", block).alias("t"), "node", F.col("node").alias("c"), "text"), least)
        of = components(inside)
        big = F.broadcast(clusters.filter("blocks > 1").select("cluster"))  # at most the bytes of all texts over block_bytes
        large = texts.join(big, "cluster", "left_semi")
        at = large.select("node", "size").join(of, "node", "left").select("node", "size", F.coalesce("component", "node").alias("c"))
        more = _across(members.select("k", "node"), cut(at), large, least, block_bytes)
        return of if more.isEmpty() else components(inside.unionByName(more))


def _across(members: DataFrame, at: DataFrame, texts: DataFrame, least: float, block_bytes: int) -> DataFrame:
    """Links between the components (c in at: node, size, c) of each bucket, by blocks of all its texts against blocks
    of those outside its largest component."""
    m = cut(members.join(at, "node"))
    shares = m.groupBy("k", "c").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    torn = shares.groupBy("k").agg(F.max_by("c", "size").alias("main"), F.sum("size").alias("size"), F.sum("n").alias("n_all"), F.max("size").alias("main_size"), F.count("*").alias("n_comps"))
    torn = torn.filter("n_comps > 1").select("k", "main", "n_all", blocks_of(F.col("size"), block_bytes).alias("blocks"), blocks_of(F.col("size") - F.col("main_size"), block_bytes).alias("others"))
    m = cut(join_hot(m.drop("size"), cut(torn), "k", "n_all", m.count()))
    block = lambda n: F.pmod(F.xxhash64("node", "k"), F.col(n)).cast("int")
    every = m.select("k", "node", "c", block("blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"))
    rest = m.filter("c != main").select("k", "node", "c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), block("others").alias("j"))
    rows = every.unionByName(rest).select(F.xxhash64("k", "i", "j").alias("t"), "node", "c").distinct()
    return linked_inside(rows.join(texts.select("node", "text"), "node"), least)


Candidates = Callable[[DataFrame], DataFrame]


def near_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, candidates: Candidates | None = None) -> DataFrame:
    """One row per input row: doc_id, node, component_id (the smallest id of all documents reachable by links). `candidates`
    makes groups (k, node) of texts (node, text), in which every pair is decided like those of MinHash."""
    named = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("node"), F.col(text_col).alias("text"))
    docs = cut(signatures(named))
    nodes = docs.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    found = cut(candidates(named.select("node", "text"))) if candidates else None
    of = nodes.join(links(docs, named, least, block_bytes, found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = cut(of)
    lows = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = cut(of.join(lows, "component").select("node", "n", "component_id"))
    return join_hot(docs.select("doc_id", "node"), of, "node", "n", docs.count()).select("doc_id", "node", "component_id")


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = SIMILARITY, candidates: Candidates | None = None) -> DataFrame:
    """The rows of df whose id is the smallest of its component, with all their columns."""
    gone = cut(near_dedup(df, text_col, id_col, least, candidates=candidates).filter("not (doc_id <=> component_id)").select("doc_id", "node").distinct())
    few = gone.count() <= BROADCAST_NODES
    gone = F.broadcast(gone) if few else gone.hint("merge")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("hash"))
    same = (F.col("hash") == F.col("node")) & F.col("id").eqNullSafe(F.col("doc_id"))
    return rows.join(gone, same, "left_anti").select("row.*")
