"""Packing by a space-filling curve.

Each document gets a hashed vector of its ids, projected to a few dimensions;
its Hilbert key orders the corpus so that neighbours on the curve are alike.
Ranges of the key go to tasks, and each task lays its documents end to end in
that order, cutting at sequence ends.  The rest that a task has at its end is
cut into sequences whose lengths are powers of two, so no sequence needs padding.

Null text: packed as empty (the end id alone).  Equal keys (copies, a hot group)
are ordered by doc_id, text hash and place, so ranges split them.  Repeated rows
are packed as rows of their own.  A very long text is encoded whole and cut over as
many sequences as it needs.  An empty table gives no pieces.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.encoding import encoder
from tidepool.llm.hilbert import hilbert_key
from tidepool.llm.tables import per_batch, release, small_batches, staged, tasks_for
from tidepool.llm.token_files import with_end

SEQUENCE, HASHED, DIMS, BITS, SEED = 2048, 256, 4, 12, 20
_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def curve_keys(ids: np.ndarray, bounds: np.ndarray, dims: int = DIMS, bits: int = BITS, hashed: int = HASHED) -> np.ndarray:
    """Hilbert keys of documents given by their ids."""
    n = len(bounds) - 1
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = (h >> np.uint64(40)).astype(np.int64) % hashed
    sign = np.where((h >> np.uint64(33)) & np.uint64(1), 1.0, -1.0)
    row = np.repeat(np.arange(n), np.diff(bounds))
    vectors = np.bincount(row * hashed + at, weights=sign, minlength=n * hashed).reshape(n, hashed)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors /= np.where(norm > 0, norm, 1)
    plane = np.random.default_rng(SEED).standard_normal((hashed, dims))
    spread = 1 / (1 + np.exp(-1.702 * (vectors @ plane)))  # near the normal distribution function
    return hilbert_key(np.minimum((spread * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def powers_of_two(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_documents(df: DataFrame, tokenizer: str = "word_bpe_49k.json", *, end_id: int = 1, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    The ids are written compressed to the shared folder, then range-sorted by
    key: the texts are encoded once, and the shuffle holds compressed ids.
    """
    small_batches(df.sparkSession)
    df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batch: pa.RecordBatch):
        enc, zip_ = encoder(tokenizer, "word"), zstandard.ZstdCompressor(level=1)
        for a, ids, bounds in enc.encode_column(batch.column(0 + 1)):
            ids, bounds = with_end(ids, bounds, end_id)
            keys = curve_keys(ids, bounds, dims, bits)
            n = len(bounds) - 1
            frames = [zip_.compress(ids[bounds[i] : bounds[i + 1]].tobytes()) for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(keys), pa.array(np.diff(bounds)), pa.array(frames, pa.binary())], names=["doc_id", "key", "doc_tokens", "frame"])

    coded = staged(df.mapInArrow(per_batch(encode), "doc_id long, key long, doc_tokens long, frame binary"), "pack")

    def lay(batches):
        from pyspark import TaskContext

        base, unzip = TaskContext.get().partitionId() << 32, zstandard.ZstdDecompressor()
        number, held, fill = 0, [], 0  # the open sequence: pieces (doc_id, start, bytes, doc_tokens) and its ids so far
        out, size = [], 0

        def close(lengths):
            nonlocal number, held, fill, out, size
            for length in lengths:
                at = 0
                while at < length:
                    doc, start, ids, total = held.pop(0)
                    n = min(len(ids) // 4, length - at)
                    if n * 4 < len(ids):
                        held.insert(0, (doc, start + n, ids[n * 4 :], total))
                    out.append((doc, start, n, ids[: n * 4], total, base + number, at))
                    at, size = at + n, size + n
                number += 1
            fill = 0

        def batch_of():
            nonlocal out, size
            columns, (out, size) = list(zip(*out)), ([], 0)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            docs, totals, frames = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for k, (doc, total) in enumerate(zip(docs, totals)):
                ids = np.frombuffer(unzip.decompress(frames[k].as_py()), dtype="<u2").astype("<u4").tobytes()
                start = 0
                while start < total:
                    n = min(total - start, sequence - fill)
                    held.append((doc, start, ids[start * 4 : (start + n) * 4], total))
                    start, fill = start + n, fill + n
                    if fill == sequence:
                        close([sequence])
                if size > 1 << 21:
                    yield batch_of()
        if fill:
            close(powers_of_two(fill))
        if out:
            yield batch_of()
        release()

    size = coded.agg(F.sum("doc_tokens")).first()[0]
    order = ["key", "doc_id", F.xxhash64("frame")]  # then, as equal rows can be a hot group, their place in the files
    ordered = coded.repartitionByRange(tasks_for(df.sparkSession, size and 2 * size), *order, F.monotonically_increasing_id()).sortWithinPartitions(*order).select("doc_id", "doc_tokens", "frame")
    return ordered.mapInArrow(lay, _PIECE)
