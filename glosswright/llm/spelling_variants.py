"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form they come from.

Two words differ by one replaced code point if they are the same without it, at the same place and of the same length;
one is the other with a code point inserted if the other is one of its deletions. So every word is given integer keys:
one for each place left out, one for each different deletion and one for itself. Polynomial hashes of all prefixes and
suffixes of a batch come from two running sums, and a deletion's hash from one of each, so a batch of words is one NumPy
expression whatever the lengths. Keys are dealt to tasks by their high bits and sorted there; those that nobody shares
go. What is left is a few rows for each near word: they fetch their words, and are compared as strings, so that a
collision of hashes links nothing.

A group of words that share a place left out has at most one word for each letter, and a group around a deletion at most
one for each letter and place, so no group grows with the input and no pairs are made: each member gets the number of
the others and the best of them.

Cases: a null text has no words; a null id counts as an empty string; texts of any length are read in slices; repeated rows count
each time; an empty table gives an empty result; a long word costs keys in proportion to its length; equal counts are
decided by code-point order; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, lean

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's form has at least so many times its count.
RATIO = 2
#: Of so many (document, run) one loses a code point.
SLIPS = 97

#: Characters of two bytes or more other than U+00C0 to U+00FF, and what is left of the others.
OTHER = re.compile(rb"[\xC2\xC4-\xF4][\x80-\xBF]+")
LETTERS = bytes(b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))
SLICE, FLUSH = 1 << 20, 200_000
#: The polynomial's base, an odd number, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
ITSELF = -1  # a key's tag: the place left out (0, 1, ...), the word itself (-1) or a deletion at place -2 - tag


def runs(text: str) -> Iterator[list[bytes]]:
    """Lower-cased letter runs of a text in UTF-8, some at a time."""
    b = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    if not b.isascii():
        b = OTHER.sub(b" ", b)
    b, at = b.translate(LETTERS), 0
    while at < len(b):
        end = b.find(b" ", at + SLICE)
        end = len(b) if end < 0 else end
        yield b[at:end].split()
        at = end


def slipped(run: bytes, h: int) -> bytes:
    """The run, without one code point if SLIPS divides h."""
    if h % SLIPS:
        return run
    word = run.decode()
    i = h % len(word)
    return (word[:i] + word[i + 1 :]).encode()


def word_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST_LENGTH) -> DataFrame:
    """word, n: how often each word of at least `least` code points occurs in all texts. A task counts what it reads and
    hands a bounded number of words on at a time."""
    import pyarrow as pa

    def packed(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                head = zlib.crc32(f"{i.as_py() or ''}:".encode())
                for some in runs(text.as_py() or ""):
                    for run, k in Counter(some).items():
                        h = zlib.crc32(run, head)
                        word = run if h % SLIPS else slipped(run, h)
                        if len(word) >= least:  # bytes, so no fewer than code points
                            total[word] += k
                    if len(total) >= FLUSH:
                        yield packed(total)
                        total = Counter()
        yield packed(total)

    d = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    got = d.mapInArrow(lean(counted), "word string, n long").filter(F.length("word") >= least)
    return got.groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Spreads a hash over all 64 bits."""
    x = x + np.asarray(salt).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, tag, place of the word in the list) of all words, none of which is empty."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(cp)
    end = np.cumsum(size)
    begin = end - size
    of = np.repeat(np.arange(len(words)), size)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n)[:n], out=sums[1:])
    back, inverse = _powers(INVERSE, n), np.uint64(INVERSE)
    whole = (sums[end] - sums[begin]) * back[begin]
    at, s, e = np.arange(n), begin[of], end[of]
    prefix, suffix = sums[at] - sums[s], sums[e] - sums[at + 1]
    without = (prefix + suffix * inverse) * back[s]  # the suffix moves down by one place
    place = at - s
    last = np.ones(n, dtype=bool)  # of equal letters in a row only the last is deleted: the others give the same
    last[:-1] = (cp[1:] != cp[:-1]) | (of[1:] != of[:-1])
    left_out = _mixed(without, 2 + place + size[of] * (1 << 32))
    deleted = _mixed(without[last], 1)
    itself = _mixed(whole, 1)
    keys = np.concatenate([left_out, deleted, itself]).view(np.int64)
    tags = np.concatenate([place, -2 - place[last], np.full(len(words), ITSELF)])
    return keys, tags, np.concatenate([of, of[last], np.arange(len(words))])


def shared(key: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Which of the rows, sorted by key, can link: two with the same place left out, or a word and a deletion."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = lambda x: np.add.reduceat(x.astype(np.int64), first)
    size = np.diff(np.r_[first, len(key)])
    out, own = tag >= 0, tag == ITSELF
    n_out, n_own = count(out), count(own)
    pair, star = np.repeat(n_out > 1, size), np.repeat((n_own > 0) & (n_out + n_own < size), size)
    return np.where(out, pair, star)


def _whole_runs(batches: Iterator, key: int = 0) -> Iterator:
    """Batches cut where the key changes, so that a key's rows come together."""
    import pyarrow as pa

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, b.slice(0, int(cuts[-1]))])
            held = [b.slice(int(cuts[-1]))]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _best(group: list[tuple[int, str, int]]) -> list[tuple[int, int, int, str]]:
    """(id, number of others, count and word of the best other) of each member (-count, word, id)."""
    group.sort()
    (a, wa, _), (b, wb, _) = group[:2]
    n = len(group) - 1
    return [(group[0][2], n, b, wb), *((i, n, a, wa) for _, _, i in group[1:])]


def linked(tags: list[int], words: list[str], counts: list[int], ids: list[int]) -> list[tuple[int, int, int, str]]:
    """(id, number of near words, minus the count and the word of the best) for whole groups of rows; a row's group is the
    string that is left, so keys that collide do not meet."""
    out: dict[tuple[int, str], list] = {}
    own: dict[str, tuple] = {}
    near: dict[str, list] = {}
    for tag, word, n, i in zip(tags, words, counts, ids, strict=True):
        row = (-n, word, i)
        if tag >= 0:
            out.setdefault((tag, word[:tag] + word[tag + 1 :]), []).append(row)
        elif tag == ITSELF:
            own[word] = row
        else:
            at = -2 - tag
            near.setdefault(word[:at] + word[at + 1 :], []).append(row)
    got = [x for group in out.values() if len(group) > 1 for x in _best(group)]
    for word, group in near.items():
        if word in own:
            n, _, i = own[word]
            got.append((i, len(group), *min(group)[:2]))
            got += [(j, 1, n, word) for _, _, j in group]
    return got


def near_words(words: DataFrame) -> DataFrame:
    """wid, n_near, best (struct of less, minus the count, and word) of the words (wid, word, n) that have a near word."""
    import pyarrow as pa

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key, tag, of = deletion_keys(b.column(1).to_pylist())
                ids = b.column(0).to_numpy()[of]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tag, pa.int32()), pa.array(ids)], ["k", "tag", "wid"])

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches):
            yield from t.filter(pa.array(shared(t.column(0).to_numpy(), t.column(1).to_numpy()))).to_batches()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches):
            got = linked(*[t.column(c).to_pylist() for c in ("tag", "word", "n", "wid")])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["wid", "n_near", "less", "word"])

    deal = lambda d: d.repartition(F.shiftrightunsigned("k", 44)).sortWithinPartitions("k")  # noqa: E731  by the high bits
    keys = deal(words.select("wid", "word").mapInArrow(lean(keyed), "k long, tag int, wid long"))
    rows = keys.mapInArrow(lean(live), "k long, tag int, wid long").join(words.hint("merge"), "wid").select("k", "tag", "wid", "word", "n")
    links = deal(rows).mapInArrow(lean(grouped), "wid long, n_near long, less long, word string")
    return links.groupBy("wid").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: what following forms ends at. A form is at least RATIO times as frequent, so there
    are no circles; each round doubles the steps that are followed."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at
        at = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """A row for each word of at least `least` code points and `least_count` occurrences: word, n, n_near, form, form_n, root."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = word_counts(df, text_col, id_col, least).filter(F.col("n") >= least_count).repartition(tasks)
    words = cut(counts.select(F.monotonically_increasing_id().alias("wid"), "word", "n"))
    near = near_words(words).select("wid", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))
    found = words.join(near, "wid", "left")
    strong = F.col("best_n") >= ratio * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")))
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")
