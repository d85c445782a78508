"""Quality classifier: a factorisation machine over hashed words, structure statistics and sizes.

score = sigmoid(w0 + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j). With rank k the pairs cost linear time:
half of (sum of v_i x_i)^2 - sum of (v_i x_i)^2 in each of the k dimensions.

Features: hashed lower-case words (log counts, scaled to length 1), structure statistics in bins (symbols, repeats,
lines, word lengths, capitals, digits, punctuation) and the text's own size as metadata. It is fitted on at most
`sample` labelled rows (a documented bound), those with the smallest seeded hashes, weighed so that both labels count
alike; features are made on the executors, whole texts. Scoring reads every text whole, in one pass.

Cases: null and empty texts are scored from their structure (no words, size 0); very long texts are whole; labels of
ids without a document and null labels teach nothing; a repeated id teaches with each of its rows; without labels every
score is 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, lean

WORDS = 1 << 14
BINS = 16
STATS = 13
DIMS = WORDS + STATS * BINS
RANK = 8
MARKS = re.compile(r"[#*$%&|<>]")


def _bin(share: float) -> int:
    return min(BINS - 1, int(share * BINS))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features that are not zero."""
    import zlib

    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    counts = Counter(w.lower() for w in words)
    lines = [x for x in text.split("\n") if x.strip()]
    same_next = sum(map(str.__eq__, words, words[1:]))
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    share = lambda a, b: a / b if b else 0.0
    upper = sum(map(str.isupper, text))
    stats = (
        share(len(MARKS.findall(text)), n), share(same_next, n), share(sum(c for c in grams.values() if c > 1), n),
        share(len(lines) - len(set(lines)), len(lines)), share(sum(map(len, words)), n) / 16, share(upper, chars),
        share(sum(map(str.isdigit, text)), chars) * 4, share(text.count("!"), n), share(text.count(".") + text.count(","), n),
        share(len(counts), n), share(max(counts.values(), default=0), n), share(n, len(lines)) / 64,
        math.log1p(n) / 12,
    )
    at = [WORDS + i * BINS + _bin(s) for i, s in enumerate(stats)]
    value = [1.0] * STATS
    if counts:
        hashed: dict[int, float] = {}
        for w, c in counts.items():
            h = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS
            hashed[h] = hashed.get(h, 0.0) + math.log1p(c)
        norm = math.sqrt(sum(x * x for x in hashed.values()))
        at += hashed.keys()
        value += [x / norm for x in hashed.values()]
    return np.array(at, dtype=np.int32), np.array(value, dtype=np.float32)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of several texts whose features stand one after another, and their factor sums."""
        vx = self.v[at] * x[:, None]
        total = np.add.reduceat(vx, begins)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, begins)).sum(axis=1)
        return self.w0 + np.add.reduceat(self.w[at] * x, begins) + pairs, total

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        at, x = zip(*map(features, texts), strict=True)
        begins = np.concatenate(([0], np.cumsum([len(a) for a in at])[:-1]))
        z, _ = self.raw(np.concatenate(at), np.concatenate(x), begins)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.03, decay: float = 1e-5, batch: int = 64, seed: int = 10) -> Machine:
    """Adam on the weighted logistic loss; the gradient of a factor is x_i (sum of v x - v_i x_i)."""
    rng = np.random.RandomState(seed)
    m = Machine(0.0, np.zeros(DIMS, np.float32), rng.normal(0, 0.01, (DIMS, RANK)).astype(np.float32))
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    mom = [np.zeros_like(m.w), np.zeros_like(m.w), np.zeros_like(m.v), np.zeros_like(m.v)]
    step, b0 = 0, 0.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            at = np.concatenate([rows[j][0] for j in pick])
            x = np.concatenate([rows[j][1] for j in pick])
            n = np.array([len(rows[j][0]) for j in pick])
            begins = np.concatenate(([0], np.cumsum(n)[:-1]))
            z, total = m.raw(at, x, begins)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            gx = np.repeat(g, n) * x
            keys, back = np.unique(at, return_inverse=True)
            gw = np.bincount(back, gx, len(keys)) + decay * m.w[keys]
            each = gx[:, None] * (np.repeat(total, n, axis=0) - m.v[at] * x[:, None])
            gv = np.stack([np.bincount(back, each[:, k], len(keys)) for k in range(RANK)], axis=1) + decay * m.v[keys]
            step += 1
            for p, grad, a, b in ((m.w, gw, mom[0], mom[1]), (m.v, gv, mom[2], mom[3])):
                a[keys] = 0.9 * a[keys] + 0.1 * grad
                b[keys] = 0.99 * b[keys] + 0.01 * grad**2
                fix = math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                p[keys] -= rate * fix * a[keys] / (np.sqrt(b[keys]) + 1e-6)
            b0 = 0.9 * b0 + 0.1 * float(g.sum())
            m.w0 -= rate * b0
    return m


def quality_scores(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", folds: int = 4, fold: int = 2, sample: int = 6000, threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Labels of the held-out fold teach nothing."""
    import pyarrow as pa

    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id", folds, fold)).distinct()
    order = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30))
    # at most `sample` ids and labels: that bounds what is broadcast to find their texts
    picked = rows.withColumn("o", order).orderBy("o", "doc_id", "label").limit(sample).select("doc_id", "label", "o")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(*features(t.as_py()), y) for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True)]
            cols = [pa.array([r[0].tobytes() for r in out], pa.binary()), pa.array([r[1].tobytes() for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[2:]], ["at", "x", "label", "o", "doc_id"])

    d = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    got = d.join(F.broadcast(picked), "doc_id").select("text", "label", "o", "doc_id").mapInArrow(lean(made), f"at binary, x binary, label int, o long, doc_id {id_type}")
    # ids may repeat with other texts: of all their rows the first `sample` in one order, whatever the partitions
    got = got.orderBy("o", "doc_id", "label", "at", "x").limit(sample).collect()
    machine = None
    if got:
        got.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["x"])))
        machine = fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got], np.array([r["label"] for r in got], dtype=np.float64))
    shared = df.sparkSession.sparkContext.broadcast(machine)  # DIMS x (RANK + 1) numbers, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [np.zeros(0)]
            for i in range(0, b.num_rows, 64):
                texts = b.column(1).slice(i, 64).to_pylist()
                s.append(m.score(texts) if m is not None else np.full(len(texts), 0.5))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(s))], ["doc_id", "score"])

    out = d.mapInArrow(lean(scored), f"doc_id {id_type}, score double")
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
