"""Substring dedup by level-wise doubling: repeats of 5 words are extended to 10, those of 10 to 20, then judged.

Only one 5-word window of the 16 in a 20-word window is followed: the one with the smallest hash, its anchor. Equal
20-word windows have the same anchor at the same place, so this loses no repeat and leaves an eighth of the windows.
Neighbouring 20-word windows with one anchor form a run, and the words they cover are the run's context.

1. Documents go to buckets of about `bucket_bytes` by hash. Each bucket sends an anchor row for each distinct context,
   however often it occurs there: copies are combined before they are shuffled.
2. Anchor rows meet by the 5-word hash. Unrepeated ones end here. In the others, equal contexts are repeats of all
   windows of the run, but for the first occurrence. Contexts that differ but share 10 words to the right or left of
   the anchor may share some 20-word windows: their first occurrences go on. Anchors that stand in very many contexts
   are counted beforehand (`heavy_keys`); their rows meet by the 10 words on each side instead, and by the context
   where those 10 words are as frequent: such a context goes on unasked, since others certainly share its 10 words.
3. Only for those, buckets send the 20-word windows themselves, again each distinct one once; equal ones are repeats
   of the first.
4. Repeated contexts and windows return to the buckets with the place of their first occurrence; the buckets remove
   the words of all others.

A bucket's documents are shuffled once and that shuffle serves all three reads. A passage that a third of all documents
share is one row per bucket, in sorts that spill. What meets in one task is thus at most a thousandth of all anchor
rows, or a row per bucket; which anchors are heavy only decides where rows meet, never the result. A window's identity
is its 64-bit hash together with that of its anchor.

Ids that are no integers (or reach the smallest one) are numbered in their own order first.

Cases: null, empty and short texts (fewer than 20 words) lose nothing; very long texts are whole; rows with the same
id are the same document to the rule "earlier", so neither of two equal rows makes the other a repeat; a null id comes
before any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, documents, lean, sha256_text

L5, L10, L20 = 5, 10, 20
WIDE = L20 - L5  # an anchor starts 0 to 15 words after its window
B = 0x9E3779B97F4A7C15  # odd: the base of the rolling hash
U = np.uint64
NO_ID = -(1 << 63)
STEP_WORDS = 200_000
#: A key with a share of 1/1000 of all anchor rows has 1/4000 of some batch's; what batches with less leave out is under 1/4000.
SHARE, LOCAL_SHARE = 1000, 4000
RIGHT, LEFT = 1 << 32, 2 << 32  # mark the 32 bits of a side
ON_BOTH, ON_RIGHT, ON_LEFT = 0, 1, 2


def _power(n: int) -> np.uint64:
    return U(pow(B, n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> U(29))) * U(0x94D049BB133111EB)


def _extend(h: np.ndarray, n: int, out: int) -> np.ndarray:
    """Hashes of twice the length from those of n words, for the `out` first places."""
    return h[:out] + _power(n) * h[n : n + out]


class Windows:
    """Hashes, anchors and runs of some documents' words, one after another."""

    def __init__(self, hashes: list[np.ndarray]):
        self.sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))
        w = np.concatenate(hashes) if hashes else np.zeros(0, U)
        n = len(w)
        self.run_doc = np.zeros(0, np.int64)
        if n < L20:
            self.a = self.b = self.p = np.zeros(0, np.int64)
            self.h20 = np.zeros(0, U)
            self.h5 = self.h10 = self.h20
            return
        h5 = w[: n - 4].copy()
        for j in range(1, L5):
            h5 += _power(j) * w[j : n - 4 + j]
        self.h5 = h5 = _mixed(h5)
        self.h10 = _extend(h5, L5, n - 9)
        self.h20 = _extend(self.h10, L10, n - 19)
        # leftmost smallest of 16 neighbours, by doubling
        low, at = h5, np.arange(len(h5))
        for step in (1, 2, 4, 8):
            m = len(low) - step
            right = low[step:] < low[:m]
            low, at = np.where(right, low[step:], low[:m]), np.where(right, at[step:], at[:m])
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        starts = np.flatnonzero(doc[: n - 19] == doc[19:])
        anchor, doc = at[starts], doc[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.a, self.p, self.run_doc = starts[first], anchor[first], doc[first]
        self.b = self.a + np.diff(np.append(first, len(starts))) - 1

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run: 5-word hash, the two 10-word hashes (32 bits each, right and left), context hash."""
        a, b, p = self.a, self.b, self.p
        ctx = _mixed(self.h20[a] + U(0xD6E8FEB86659FD93) * self.h20[b] + ((p - a) * 64 + (b - a)).astype(U))
        # a side that no window of the run needs gets the context's own bits: it never joins different contexts
        right = np.where(p - b <= L10, _mixed(self.h10[np.minimum(p, len(self.h10) - 1)]), ctx)
        left = np.where(p - a > L10, _mixed(self.h10[np.maximum(p - L5, 0)]), ctx + U(1))
        return self.h5[p], (right & U(0xFFFFFFFF) << U(32)) | (left >> U(32)), ctx


def word_hashes(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    import xxhash

    if len(cache) > 500_000:
        cache.clear()
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=U)


def _batches(table, only: set[int] | None = None) -> Iterator[tuple[list[int], list[list[bytes]], Windows]]:
    """Documents of a bucket in steps: ids, words, windows."""
    ids, words, hashes, total, cache = [], [], [], 0, {}
    for i, t in zip(table.column("doc_id"), table.column("text"), strict=True):
        i, t = i.as_py(), t.as_py()
        i = NO_ID if i is None else i
        if only is not None and i not in only:
            continue
        ids.append(i)
        words.append((t or "").encode().split())  # bytes: ASCII white space only
        hashes.append(word_hashes(words[-1], cache))
        total += len(words[-1])
        if total >= STEP_WORDS:
            yield ids, words, Windows(hashes)
            ids, words, hashes, total = [], [], [], 0
    if ids:
        yield ids, words, Windows(hashes)


def _firsts(keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row (smallest doc, then pos) of each distinct key, and how many rows have it."""
    order = np.lexsort((pos, doc, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def _table(schema: dict, columns: list):
    import pyarrow as pa

    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


def _kinds(*names: str) -> dict:
    import pyarrow as pa

    return {n.split(":")[0]: pa.int32() if n.endswith(":int") else pa.int64() for n in names}


ANCHOR = ("h5", "h10", "ctx", "doc", "pos:int", "n:int", "bucket:int")
WINDOW = ("h20", "h5", "doc", "pos:int", "n:int", "bucket:int")


def _ddl(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n.split(':')[0]} {'int' if n.endswith(':int') else 'long'}" for n in names)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def send_anchors(table):
    """Anchor rows of a bucket: one per distinct context."""
    cols: list[list[np.ndarray]] = [[] for _ in range(5)]
    for ids, _, win in _batches(table):
        h5, h10, ctx = win.keys() if len(win.a) else (np.zeros(0, U),) * 3
        d = np.array(ids, dtype=np.int64)[win.run_doc]
        for c, x in zip(cols, (h5, h10, ctx, d, win.p - win.begins[win.run_doc]), strict=True):
            c.append(x)
    h5, h10, ctx, doc, pos = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
    at, n = _firsts([ctx, h5], doc, pos)
    bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
    return _table(_kinds(*ANCHOR), [_signed(h5[at].astype(U)), _signed(h10[at].astype(U)), _signed(ctx[at].astype(U)), doc[at], pos[at], np.minimum(n, 1 << 30), np.full(len(at), bucket)])


def count_heavy(batches):
    """How often each step's frequent keys (h5 alone, half 0; h5 and a side's 10 words) head a distinct context; half -1: all contexts."""
    for batch in batches:
        for _, _, win in _batches(batch):
            if not len(win.a):
                continue
            h5, h10, ctx = win.keys()
            at, _ = _firsts([ctx, h5], np.zeros(len(h5), np.int64), win.p)
            h5, h10 = h5[at], h10[at]
            least = max(2, -(-len(at) // LOCAL_SHARE))
            rows = [(0, -1, len(at))]
            for half in (np.zeros(len(at), U), (h10 >> U(32)) | U(RIGHT), (h10 & U(0xFFFFFFFF)) | U(LEFT)):
                first, n = _firsts([half, h5], np.zeros(len(at), np.int64), np.arange(len(at)))
                often = n >= least
                rows += zip(_signed(h5[first[often]]).tolist(), _signed(half[first[often]]).tolist(), n[often].tolist(), strict=True)
            yield from _table(_kinds("h5", "half", "n"), list(zip(*rows, strict=True))).to_batches()


def heavy_keys(d: DataFrame) -> DataFrame:
    """h5 and half of every key with at least 1/SHARE of all contexts; at most LOCAL_SHARE keys, whatever the input."""
    counts = cut(d.mapInArrow(lean(count_heavy), "h5 long, half long, n long").groupBy("h5", "half").agg(F.sum("n").alias("n")))
    total = counts.filter("half = -1").agg(F.sum("n")).first()[0] or 0
    # a share of 1/SHARE less the part that batches leave out
    least = total / SHARE - total / LOCAL_SHARE
    return counts.filter((F.col("half") >= 0) & (F.col("n") >= F.lit(least))).select("h5", "half")


def send_windows(docs, checks):
    """20-word windows of the runs in checks (doc, pos, right, left), each distinct one once."""
    want = {}
    for d, p, r, left in zip(*(checks.column(c).to_pylist() for c in ("doc", "pos", "right", "left")), strict=True):
        old = want.get((d, p), (0, 0))
        want[d, p] = (r or old[0], left or old[1])
    rows: list[list[np.ndarray]] = [[] for _ in range(4)]
    if want and docs.num_rows:
        for ids, _, win in _batches(docs, {d for d, _ in want}):
            at = win.p - win.begins[win.run_doc]
            for k, (d, p) in enumerate(zip(win.run_doc.tolist(), at.tolist(), strict=True)):
                sides = want.get((ids[d], p))
                if sides is None:
                    continue
                s = np.arange(win.a[k], win.b[k] + 1)
                near = win.p[k] - s <= L10
                s = s[(near & bool(sides[0])) | (~near & bool(sides[1]))]
                for c, x in zip(rows, (win.h20[s], np.full(len(s), win.h5[win.p[k]]), np.full(len(s), ids[d]), s - win.begins[d]), strict=True):
                    c.append(x)
    h20, h5, doc, pos = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in rows)
    at, n = _firsts([h20, h5], doc, pos)
    bucket = checks.column("bucket")[0].as_py() if checks.num_rows else 0
    return _table(_kinds(*WINDOW), [_signed(h20[at].astype(U)), _signed(h5[at].astype(U)), doc[at], pos[at], np.minimum(n, 1 << 30), np.full(len(at), bucket)])


class Repeats:
    """Repeated contexts or windows (a hash and its anchor's) with the place that stays."""

    def __init__(self, marks, kind: int):
        m = {c: marks.column(c).to_numpy() for c in ("kind", "key", "h5", "doc", "pos")}
        pick = m["kind"] == kind
        order = np.argsort(m["key"][pick].view(U), kind="stable")
        self.key, self.h5, self.doc, self.pos = m["key"][pick].view(U)[order], m["h5"][pick].view(U)[order], m["doc"][pick][order], m["pos"][pick][order]

    def hits(self, key: np.ndarray, h5: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which of the places are repeats: their key is here, and they are not the place that stays."""
        out = np.zeros(len(key), bool)
        if not len(self.key):
            return out
        i, last = np.searchsorted(self.key, key), len(self.key) - 1
        todo = np.flatnonzero(self.key[np.minimum(i, last)] == key)
        i = i[todo]
        while len(todo):  # equal keys stand together; almost always there is one
            same = self.h5[i] == h5[todo]
            out[todo[same]] = (self.doc[i[same]] != doc[todo[same]]) | (self.pos[i[same]] != pos[todo[same]])
            i = i + 1
            more = (i <= last) & (self.key[np.minimum(i, last)] == key[todo]) & ~same
            todo, i = todo[more], i[more]
        return out


def remove_marked(id_type) -> Callable:
    def removed(docs, marks):
        import pyarrow as pa

        runs, windows = (Repeats(marks, kind) for kind in (0, 1)) if marks.num_rows else (None, None)
        out: list[tuple] = []
        for ids, words, win in _batches(docs):
            cover = np.zeros(int(win.begins[-1]) + 1, np.int32)  # +1 where a marked stretch begins, -1 after it
            if runs is not None and len(win.a):
                k5, _, ctx = win.keys()
                doc_of, begin = np.array(ids, dtype=np.int64)[win.run_doc], win.begins[win.run_doc]
                hit = runs.hits(ctx, k5, doc_of, win.p - begin)
                np.add.at(cover, win.a[hit], 1)
                np.add.at(cover, win.b[hit] + L20, -1)
                if len(windows.key):
                    many = win.b - win.a + 1
                    s = np.repeat(win.b + 1 - np.cumsum(many), many) + np.arange(many.sum())
                    s = s[windows.hits(win.h20[s], np.repeat(k5, many), np.repeat(doc_of, many), s - np.repeat(begin, many))]
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + L20, -1)
            gone = np.cumsum(cover)[:-1] > 0
            for k, d in enumerate(ids):
                g = gone[win.begins[k] : win.begins[k + 1]]
                kept = words[k] if not g.any() else [w for w, x in zip(words[k], g.tolist(), strict=True) if not x]
                raw = b" ".join(kept)
                out.append((None if d == NO_ID else d, len(g), int(g.sum()), raw.decode()))
        kinds = (id_type, pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return removed


def right_half() -> Column:
    return F.shiftrightunsigned("h10", 32)


def left_half() -> Column:
    return F.col("h10").bitwiseAND(F.lit(0xFFFFFFFF))


def spread(anchors: DataFrame, heavy: DataFrame) -> DataFrame:
    """Anchor rows with side and sub: rows of equal h5, side and sub meet. A heavy anchor's rows come once for each side."""
    heavy5 = heavy.filter("half = 0").select("h5", F.lit(True).alias("heavy5"))
    heavy10 = heavy.filter("half > 0").select("h5", F.col("half").alias("sub"), F.lit(True).alias("heavy10"))
    a = anchors.join(F.broadcast(heavy5), "h5", "left")
    a = a.withColumn("side", F.explode(F.when(F.col("heavy5"), F.array(F.lit(ON_RIGHT), F.lit(ON_LEFT))).otherwise(F.array(F.lit(ON_BOTH)))))
    half = F.when(F.col("side") == ON_RIGHT, right_half().bitwiseOR(F.lit(RIGHT))).when(F.col("side") == ON_LEFT, left_half().bitwiseOR(F.lit(LEFT)))
    a = a.withColumn("sub", half.otherwise(F.lit(0).cast("long")))
    a = a.join(F.broadcast(heavy10), ["h5", "sub"], "left").withColumn("heavy10", F.col("heavy10").isNotNull())
    return a.withColumn("sub", F.when(F.col("heavy10"), F.col("ctx")).otherwise(F.col("sub"))).drop("heavy5")


def substring_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and kept_text (the kept words, single spaces)."""
    import pyarrow as pa

    d = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole = isinstance(d.schema["doc_id"].dataType, IntegralType)
    found = d.agg(F.sum(F.octet_length("text")).alias("s"), F.min("doc_id").alias("low")).first()
    size = found["s"] or 0
    if not whole or found["low"] == NO_ID:
        # range-sorted parts are numbered part by part, so the numbers keep the order of the ids
        ids = cut(d.select("doc_id").filter("doc_id is not null").distinct().orderBy("doc_id").select(F.col("doc_id").alias("_id"), F.monotonically_increasing_id().alias("_n")))
        numbered = d.join(ids, F.col("doc_id") == F.col("_id"), "left").select(F.col("_n").alias("doc_id"), "text")
        out = substring_dedup(numbered, bucket_bytes=bucket_bytes)
        return out.join(ids, F.col("doc_id") == F.col("_n"), "left").select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_text")
    d = d.withColumn("doc_id", F.col("doc_id").cast("long"))
    buckets = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // bucket_bytes))
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    docs = d.groupBy("bucket")

    anchors = docs.applyInArrow(send_anchors, _ddl(ANCHOR))
    over = lambda *k: W.partitionBy(*k)
    key = ("h5", "sub", "side")
    a = spread(anchors, heavy_keys(d))
    a = a.repartition(*key).withColumn("n5", F.sum("n").over(over(*key))).filter("n5 > 1 or heavy10")
    place = F.struct("doc", "pos")
    a = a.withColumn("first", F.min(place).over(over(*key, "ctx"))).withColumn("n_ctx", F.sum("n").over(over(*key, "ctx")))
    a = a.withColumn("lead", F.when((F.row_number().over(over(*key, "ctx").orderBy("doc", "pos", "bucket")) == 1), 1).otherwise(0))
    a = a.withColumn("r10", right_half()).withColumn("l10", left_half())
    shared = lambda half, other: (F.col("heavy10") | (F.sum("lead").over(over(*key, half)) > 1)) & (F.col("side") != other)
    a = a.withColumn("right", shared("r10", ON_LEFT).cast("long")).withColumn("left", shared("l10", ON_RIGHT).cast("long"))
    stay = [F.col("first.doc").alias("doc"), F.col("first.pos").cast("long").alias("pos")]
    # both reads of the anchor rows must share one shuffle: so h10, of no use here, and no filter on the key alone, which would be moved below it
    runs = a.filter((F.when(F.col("side") != ON_LEFT, F.col("n_ctx")).otherwise(0) > 1) & F.col("h10").isNotNull()).select("bucket", F.lit(0).alias("kind"), F.col("ctx").alias("key"), "h5", *stay)
    checks = a.filter("lead = 1 and (right = 1 or left = 1)").select("bucket", "doc", F.col("pos").cast("long").alias("pos"), "right", "left")

    windows = docs.cogroup(checks.groupBy("bucket")).applyInArrow(send_windows, _ddl(WINDOW))
    w = windows.repartition("h20").withColumn("first", F.min(place).over(over("h20", "h5"))).withColumn("n_all", F.sum("n").over(over("h20", "h5")))
    marks = runs.unionByName(w.filter("n_all > 1").select("bucket", F.lit(1).alias("kind"), F.col("h20").alias("key"), "h5", *stay))
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return docs.cogroup(marks.groupBy("bucket")).applyInArrow(remove_marked(pa.int64()), schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", sha256_text(F.col("kept_text")).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents)
), g AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER win AS win, count(*) OVER win AS n
  FROM w WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), r AS (
  SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY md5(win), n ORDER BY doc_id, i) > 1 AS rep FROM g
), c AS (
  SELECT doc_id, i, word, coalesce(bool_or(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM r
)
SELECT d.doc_id, count(c.i) AS n_words, count(c.i) FILTER (c.gone) AS n_removed,
       sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.i) FILTER (NOT c.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""
