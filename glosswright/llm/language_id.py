"""Language ID by nearest centroids.

A text becomes a TF-IDF vector of hashed byte trigrams (of lower-case words without digits and marks), normalised to
length 1. Each language has a few centroids, found by spherical k-means among its own texts, so that one language may
have several styles. The language of the centroid with the highest cosine wins. A text whose best cosine lies below
the rejection threshold is too far from every centroid; the threshold is a fraction of a low quantile of the
cosines of the training texts to their own language. A text of fewer than SHORT trigrams shares few with anything; it
says too little to be called far and is not rejected for its distance.

The model is fitted on at most `sample` labelled texts (a documented bound; the sample is collected as trigram counts,
whole texts counted); document frequencies are those of all training texts. The languages share the sample evenly, what a rare one
leaves going to the others, but each gets FEWEST texts if it has them; of a language those with the smallest seeded
hashes are taken, exactly, equal rows counting once. Scoring reads every text whole, in one pass without a shuffle.

Cases: a null text or one without a letter gets `und` and score 0; very long texts are counted slice by slice;
repeated rows and ids are scored one by one; without any training text every text gets `und`; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents, held_out, lean

DIMS = 1 << 13
SLICE = 1 << 20
UND = "und"
SHORT = 100
BLOCK = 128  # texts that are scored at once
FEWEST = 20  # texts of a language that are learned from, however many languages share the sample
BUCKETS = 12  # bits of the order by which the cut is found before single rows are ranked
ORDER_BITS = 30


def _letters() -> np.ndarray:
    """Byte table: ASCII letters in lower case, bytes of other characters as they are, all else a space."""
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    for i in range(26):
        t[65 + i] = t[97 + i] = 97 + i
    return t


LETTERS = _letters()


def trigrams(text: str | None) -> np.ndarray | None:
    """Counts of hashed trigrams; None for a text without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    counts = np.zeros(DIMS, np.int64)
    for i in range(0, len(raw), SLICE):
        b = LETTERS[raw[max(0, i - 2) : i + SLICE]].astype(np.uint32)
        b = np.pad(b, 1, constant_values=32) if len(raw) <= SLICE else b
        if len(b) < 3:
            continue
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[(b[1:-1] != 32)]
        counts += np.bincount(((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64), minlength=DIMS)
    return counts


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of length 1
    owner: np.ndarray  # index of each centroid's language
    threshold: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        """The vectors of counts (floats), in the same memory."""
        x = np.log1p(counts, out=counts)
        x *= self.idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)
        return x

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and cosine of the nearest centroid."""
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(axis=1)
        return self.owner[best], np.clip(cos[np.arange(len(cos)), best], 0, 1)


def fit(langs: list[str], counts: np.ndarray, df: np.ndarray, n: int, per_lang: int = 4, rounds: int = 12, quantile: float = 0.01, fraction: float = 0.5) -> Model:
    """A model from the sample's counts; df: in how many of all n training texts each trigram bucket occurs."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], dtype=np.int64)
    m = Model(names, (np.log((1 + n) / (1 + df)) + 1).astype(np.float32), np.zeros((0, DIMS)), np.zeros(0, np.int64), 0.0)
    x, cents, owner = m.vectors(counts), [], []
    for k in range(len(names)):
        own = x[y == k]
        c = own[np.linspace(0, len(own) - 1, min(per_lang, len(own))).astype(int)]
        for _ in range(rounds):
            at = (own @ c.T).argmax(axis=1)
            sums = np.stack([own[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
            c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        cents.append(c)
        owner += [k] * len(c)
    m.centroids, m.owner = np.concatenate(cents), np.array(owner, dtype=np.int64)
    cos = x @ m.centroids.T
    own_cos = np.where(m.owner[None, :] == y[:, None], cos, -1.0).max(axis=1)
    m.threshold = float(fraction * np.quantile(own_cos, quantile))
    return m


def fair_level(sizes: list[int], sample: int, fewest: int = FEWEST) -> int:
    """The number of texts that a language may give so that all together give at most `sample` (or `fewest` each)."""
    left, level = sample, max(sizes, default=0)
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if n > share:
            level = share
            break
        left -= n
    return max(level, fewest)


def smallest(keys: DataFrame, sample: int) -> DataFrame:
    """Of each label the rows of keys (label, o, doc_id, digest; no row twice) with the smallest (o, doc_id, digest), as
    many as its share of the sample. Rows are counted by leading bits of o first, so that only those up to a label's cut
    are ever ranked together."""
    n = {r["label"]: r["n"] for r in keys.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row per language
    level = fair_level(list(n.values()), sample)
    bucket = F.shiftright("o", ORDER_BITS - BUCKETS)
    counted = keys.groupBy("label", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("label").orderBy("bucket")) - F.col("n")
    cuts = counted.withColumn("before", before).filter(F.col("before") < level).groupBy("label").agg(F.max("bucket").alias("cut"))
    low = keys.join(F.broadcast(cuts), "label").filter(bucket <= F.col("cut"))
    place = F.row_number().over(W.partitionBy("label").orderBy("o", "doc_id", "digest"))
    return low.withColumn("place", place).filter(F.col("place") <= level).select("label", "doc_id", "digest")


def training_counts(df: DataFrame, sample: int) -> list:
    """Trigram counts (as sparse pairs) and labels of the training sample of df (doc_id, text, lang)."""
    import pyarrow as pa

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = trigrams(t.as_py())
                if c is not None:
                    at = np.flatnonzero(c)
                    rows.append((lang, at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
            kinds = (pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["label", "at", "n"])

    rows = df.select(F.col("lang").alias("label"), "doc_id", "text", F.xxhash64("text").alias("digest"))
    # only ids, labels and digests are shuffled; the texts of the chosen rows are then read again
    order = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << ORDER_BITS))
    keys = cut(rows.select("label", order.alias("o"), "doc_id", "digest").distinct())
    chosen = F.broadcast(cut(smallest(keys, sample)))  # at most `sample` rows, or FEWEST a language
    got = rows.join(chosen, ["label", "doc_id", "digest"]).groupBy("label", "doc_id", "digest").agg(F.first("text").alias("text"))
    return got.select("label", "text").mapInArrow(lean(counted), "label string, at binary, n binary").collect()


def document_frequencies(df: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of df (column text) each trigram bucket occurs, and how many texts have a letter."""
    import pyarrow as pa

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                c = trigrams(t.as_py())
                if c is not None:
                    seen[:DIMS] += c > 0
                    seen[DIMS] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for r in df.select("text").mapInArrow(lean(counted), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        out[r["at"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def train(df: DataFrame, text_col: str, id_col: str, lang_col: str, folds: int, fold: int, sample: int) -> Model | None:
    """A model from the rows outside the held-out fold that have an id and a language; None if there are none."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    got = training_counts(rows, sample)
    if not got:
        return None
    got.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["n"])))
    counts = np.zeros((len(got), DIMS), np.float32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
    labels = [r["label"] for r in got]
    del got
    model = fit(labels, counts, *document_frequencies(rows))
    model.centroids = model.centroids.astype(np.float32)
    return model


def judge(m: Model | None, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, for each of an Arrow column's texts."""
    n = len(texts)
    langs, scores, rejected = [UND] * n, np.zeros(n), np.ones(n, bool)
    for i in range(0, n if m is not None else 0, BLOCK):
        part = [(k, c) for k in range(i, min(n, i + BLOCK)) if (c := trigrams(texts[k].as_py())) is not None]
        if not part:
            continue
        at, counts = [k for k, _ in part], np.array([c for _, c in part], dtype=np.float32)
        enough = counts.sum(axis=1) >= SHORT
        who, cos = m.score(counts)
        scores[at], rejected[at] = cos, (cos < m.threshold) & enough
        for k, w in zip(at, who, strict=True):
            langs[k] = m.langs[w]
    return langs, scores, rejected


def identify(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", folds: int = 5, fold: int = 0, sample: int = 3000) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (cosine, 0 to 1), rejected. Rows of the held-out fold
    and rows without a language teach nothing."""
    import pyarrow as pa

    model = train(df, text_col, id_col, lang_col, folds, fold, sample)
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x per_lang x DIMS numbers, whatever the input

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, rejected = judge(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    d = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = d.mapInArrow(lean(predicted), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", folds: int = 5, fold: int = 0, sample: int = 3000) -> DataFrame:
    """The rows of df that are not rejected, with all their columns; nothing is shuffled."""
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(train(df, text_col, id_col, lang_col, folds, fold, sample))
    at = df.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~judge(shared.value, b.column(at))[2]))

    return df.mapInArrow(lean(kept), df.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
