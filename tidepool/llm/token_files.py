"""Token-id files: one zstandard frame per document under a shared dictionary.

A file set is a folder with two Parquet tables, so that any store that Spark
writes will hold it:

``dictionary``  one row: dict_hash (SHA-256), dictionary, tokenizer, id_bytes.
``segments``    a row per segment of about ``segment_bytes``: part, segment (its
                place in the part), part_start (ids of the part before it),
                first_doc, last_doc, n_tokens, doc_ids, counts, offsets (of each
                document's frame in the payload, with the end), payload, dict_hash.

Parts are ranges of ascending doc_id, so (part, segment, position) is the global
order.  A short document is read by decompressing its own frame alone; min/max
statistics of first_doc and last_doc prune the segments.

The dictionary is trained on the ids of a bounded sample: ``sample_docs``
documents with the smallest hash of their id, the first ``sample_ids`` ids of
each.  It only shapes the compression; every document is encoded whole.

Null text: encoded as empty (the end id alone).  Null doc_ids come first.  Equal
doc_ids are all kept, in the order of a hash of their texts.  A very long text is one
frame, in a segment of its own if it is longer than one.  An empty table gives a file
set without segments.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.encoding import encoder
from tidepool.llm.tables import per_batch, small_batches, tasks_for

SEGMENT_BYTES, SEGMENT_DOCS = 1 << 20, 1 << 13
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES, LEVEL = 512, 4096, 1 << 16, 3

_SEGMENT = "part int, segment long, part_start long, first_doc long, last_doc long, n_tokens long, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary, dict_hash string"


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids with the end id behind them."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], np.uint16(end_id)), bounds + np.arange(n + 1)


def train_dictionary(df: DataFrame, tokenizer: str, *, id_col: str, text_col: str, sample_docs: int, sample_ids: int, dict_bytes: int) -> bytes:
    """A dictionary from a bounded sample; empty where there is too little to train on."""
    picked = [r[0] for r in df.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample_docs).collect()]
    if not picked:
        return b""

    def run(batch: pa.RecordBatch):
        enc, out = encoder(tokenizer, "word"), []
        for _, ids, bounds in enc.encode_column(batch.column(0)):
            out += [ids[bounds[i] : bounds[i + 1]][:sample_ids].tobytes() for i in range(len(bounds) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    rows = df.where(F.col(id_col).isin(picked)).select(F.col(text_col)).limit(2 * sample_docs).mapInArrow(per_batch(run), "ids binary").collect()
    samples = sorted(bytes(r[0]) for r in rows if r[0])
    try:
        return zstandard.train_dictionary(dict_bytes, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b"".join(samples)[:dict_bytes]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_token_files(df: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, sample_docs: int = SAMPLE_DOCS, sample_ids: int = SAMPLE_IDS, dict_bytes: int = DICT_BYTES) -> None:
    """Write the file set at ``path`` (see the module): one shuffle of the texts by ranges of the id."""
    small_batches(df.sparkSession)
    spark = df.sparkSession
    df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw = train_dictionary(df, tokenizer, id_col="doc_id", text_col="text", sample_docs=sample_docs, sample_ids=sample_ids, dict_bytes=dict_bytes)
    digest = hashlib.sha256(raw).hexdigest()
    schema = "dict_hash string, dictionary binary, tokenizer string, id_bytes int"
    spark.createDataFrame([(digest, raw, tokenizer, 2)], schema).coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches):
        from pyspark import TaskContext

        enc, zip_ = encoder(tokenizer, "word"), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        part, segment, done = TaskContext.get().partitionId(), 0, 0
        docs, counts, frames, size = [], [], [], 0

        def flush():
            nonlocal segment, done, docs, counts, frames, size
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])])
            known = [d for d in docs if d is not None]
            row = {"part": part, "segment": segment, "part_start": done, "first_doc": known[0] if known else None, "last_doc": known[-1] if known else None, "n_tokens": sum(counts), "doc_ids": docs, "counts": counts, "offsets": offsets.tolist(), "payload": b"".join(frames), "dict_hash": digest}
            segment, done = segment + 1, done + row["n_tokens"]
            docs, counts, frames, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow_segment())

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, ids, bounds in enc.encode_column(batch.column(1)):
                ids, bounds = with_end(ids, bounds, end_id)
                for i in range(len(bounds) - 1):
                    frames.append(zip_.compress(ids[bounds[i] : bounds[i + 1]].tobytes()))
                    docs.append(names[a + i])
                    counts.append(int(bounds[i + 1] - bounds[i]))
                    size += len(frames[-1])
                    if size >= segment_bytes or len(docs) >= SEGMENT_DOCS:
                        yield flush()
        if docs:
            yield flush()

    size = df.agg(F.sum(F.octet_length("text"))).first()[0]
    order = ["doc_id", F.xxhash64("text")]
    df.repartitionByRange(tasks_for(spark, size), *order).sortWithinPartitions(*order).mapInArrow(run, _SEGMENT).write.parquet(f"{path}/segments")


def _arrow_segment() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("part_start", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", longs), ("counts", longs), ("offsets", longs), ("payload", pa.binary()), ("dict_hash", pa.string())])


def read_token_files(spark: SparkSession, path: str, *, doc_ids: list[int] | None = None) -> DataFrame:
    """Per document of the file set: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    ``doc_ids``: only these, by pruning segments and decompressing their frames alone.
    """
    small_batches(spark)
    head = spark.read.parquet(f"{path}/dictionary").first()
    digest, raw = head["dict_hash"], bytes(head["dictionary"])
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError("the dictionary is damaged")
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    parts = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row per file part
    bases = np.concatenate([[0], np.cumsum([n for _, n in parts])])[:-1].tolist() if parts else []
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(parts, bases)], "part int, base long")
    wanted = None
    if doc_ids is not None:
        wanted = set(doc_ids)
        low, high = (min(wanted), max(wanted)) if wanted else (0, -1)
        segments = segments.where((F.col("first_doc") <= high) & (F.col("last_doc") >= low))
    rows = segments.join(base, "part").select((F.col("base") + F.col("part_start")).alias("start"), "doc_ids", "counts", "offsets", "payload", "dict_hash")

    def run(batch: pa.RecordBatch):
        unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for k in range(batch.num_rows):
            start, docs, counts, offsets, payload, hashed = (c[k].as_py() for c in batch.columns)
            if hashed != digest:
                raise ValueError("a segment was written with another dictionary")
            starts = (start + np.concatenate([[0], np.cumsum(counts)])[:-1]).tolist()
            pick = range(len(docs)) if wanted is None else [i for i, d in enumerate(docs) if d in wanted]
            for g in range(0, len(pick), 1024):
                some = pick[g : g + 1024]
                ids = [np.frombuffer(unzip.decompress(payload[offsets[i] : offsets[i + 1]]), dtype="<u2").astype("<u4").tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in some], pa.int64()), pa.array([starts[i] for i in some], pa.int64()), pa.array([counts[i] for i in some], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(per_batch(run), "doc_id long, start long, n_tokens long, ids binary")
