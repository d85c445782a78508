"""Byte-level BPE by overlapping chunks.

Every text is cut into chunks that overlap. Where a pre-token ends depends only on what follows its start, so two chunks
that agree on one pre-token boundary agree on all that follow: chunks are pre-tokenised separately, and the first
boundary that both have (and that lies clear of a chunk's end and of white space) is where they are stitched. Without
such a boundary (a word longer than the overlap) the left chunk is read on, in windows that double. The pre-tokens
between stitches are then encoded one by one, and their ids joined. Decoding joins the bytes of the ids.

Chunks bound the memory and the time of very long texts: a pattern runs over more than a chunk only inside one word.
The chunks of a text of more than one are dealt to all tasks, and their boundaries (numbers only) meet again by text; a
text of one chunk has nothing to stitch and is encoded where it was read. Nothing is pre-tokenised twice. The vocabulary
is read once in each Python worker from a path that is a parameter.

Cases: null and empty texts have no ids; unpaired surrogates cannot occur in Spark strings; repeated rows and ids are
encoded one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean

CHUNK, OVERLAP = 1 << 14, 1 << 8
#: A boundary is certain only if the pattern saw at least so many characters after it.
CLEAR = 4
ROWS = 256
MOST_PIECES = 300_000  # pieces whose ids a worker remembers


class Codec:
    """Encodes and decodes with a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = tiktoken.Encoding("piece", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pretoken = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.token[i] = b

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Ends of the pre-tokens of text[start:end] by itself, as far as what follows cannot change them."""
        return self.ends(text[start:end], start, start + len(text[start:end]) >= len(text))

    def ends(self, window: str, start: int, is_last: bool) -> list[int]:
        last = len(window) if is_last else len(window) - CLEAR
        out = list(accumulate(map(len, self.pretoken.findall(window))))
        while out and out[-1] > last:
            out.pop()
        return [start + e for e in out] if start else out

    def stitched(self, text: str, chunks: list[list[int]], chunk: int) -> list[int]:
        """All pre-token boundaries of a text from those of its chunks, each found without knowing the others."""
        known = list(chunks[0])
        for c, own in enumerate(chunks[1:], 1):
            s, both = c * chunk, set(own)
            near = known[bisect_right(known, s) :]
            stitch = next((b for b in near if b in both and not text[b - 1].isspace()), None)
            if stitch is not None:
                known = [*known[: bisect_right(known, stitch)], *own[bisect_right(own, stitch) :]]
                continue
            width = chunk  # the left side is read on from its last boundary, until it ends beyond this chunk's
            stop = min(len(text), s + 2 * chunk)
            while (at := known[-1] if known else 0) < stop:
                more = self.boundaries(text, at, at + 2 * width)
                known += more
                if not more and at + 2 * width >= len(text):
                    break
                width = width if more else 2 * width
        return known

    def chunks(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        return [text[s : s + chunk + overlap] for s in range(0, max(1, len(text)), chunk)]

    def encode(self, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        text = text or ""
        parts = self.chunks(text, chunk, overlap)
        own = [self.ends(p, i * chunk, i * chunk + len(p) >= len(text)) for i, p in enumerate(parts)]
        return self.encode_pieces(text, self.stitched(text, own, chunk))

    def encode_pieces(self, text: str, ends: list[int]) -> np.ndarray:
        """Ids of a text whose pre-tokens end at `ends`."""
        out: list[int] = []
        start, known = 0, self.known
        for e in ends:
            piece = text[start:e]
            ids = known.get(piece)
            if ids is None:
                ids = self.pieces._encode_single_piece(piece)
                if len(known) < MOST_PIECES and len(piece) < 64:
                    known[piece] = ids
            out += ids
            start = e
        return np.array(out, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as tokenizers

    return tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


def encode_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, pattern: str | None = None, decoded: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and, if asked for, decoded: the
    bytes that the ids decode to. path is read on each executor."""
    import pyarrow as pa

    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    d = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]
    schema = f"doc_id {id_type}, n_tokens long, ids binary" + ", decoded binary" * decoded

    def result(c: Codec, doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        cols = [doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
        if decoded:
            cols.append(pa.array([c.decode(x) for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):  # a few texts at a time: ids and bytes are larger than texts
                part = b.slice(i, ROWS)
                yield result(c, part.column(0), [c.encode(t.as_py(), chunk, overlap) for t in part.column(1)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for r in range(b.num_rows):
                parts = c.chunks(b.column(2)[r].as_py(), chunk, overlap)
                same = [pa.array([b.column(x)[r].as_py()] * len(parts), b.column(x).type) for x in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(parts)), pa.int32()), pa.array([len(parts)] * len(parts), pa.int32()), pa.array(parts)], ["key", "doc_id", "i", "n", "text"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            own = [c.ends(t.as_py(), i * chunk, i == n - 1) for i, n, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array(own, pa.list_(pa.int32()))], ["key", "doc_id", "i", "text", "ends"])

    def joined(table: pa.Table) -> pa.Table:
        c = codec(path, pattern)
        t = table.sort_by("i")
        copies = sum(i == 0 for i in t.column("i").to_pylist())  # equal rows come as one group
        parts = [t.column(x).to_pylist()[::copies] for x in ("text", "ends")]
        text = "".join(p[:chunk] for p in parts[0][:-1]) + parts[0][-1]
        ids = c.encode_pieces(text, c.stitched(text, parts[1], chunk))
        return pa.Table.from_batches([result(c, t.column("doc_id").combine_chunks().slice(0, copies), [ids] * copies)])

    n = F.greatest(F.lit(1), F.ceil(F.length("text") / chunk)).cast("int")
    one = d.filter(F.coalesce(n, F.lit(1)) == 1).mapInArrow(lean(encoded), schema)
    # rows meet again by a SHA-256 of id and text, so only equal rows share a key
    name = F.coalesce(F.concat(F.lit("1"), F.col("doc_id").cast("string")), F.lit("0"))
    key = F.sha2(F.concat(name, F.lit("\0"), F.col("text")), 256)
    long = d.filter(n > 1).select(key.alias("key"), "doc_id", "text").mapInArrow(lean(dealt), f"key string, doc_id {id_type}, i int, n int, text string")
    long = long.repartition("key", "i").mapInArrow(lean(bounded), f"key string, doc_id {id_type}, i int, text string, ends array<int>")
    return one.unionByName(long.groupBy("key").applyInArrow(joined, schema))


def decode_documents(df: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per input row: doc_id and decoded, the bytes of its ids one after another; null ids decode to nothing."""
    import pyarrow as pa

    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    d = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            raw = [c.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return d.mapInArrow(lean(read), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, decoded binary")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = encode_documents(documents(spark, sf_dir), decoded=True)
    return d.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
