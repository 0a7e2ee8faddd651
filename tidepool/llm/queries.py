"""Registered queries of the llm operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import sql
from tidepool.llm.ann import nearest
from tidepool.llm.chat import format_transcripts
from tidepool.llm.conversation_repair import audits, repaired_digests
from tidepool.llm.jaccard import similar_groups
from tidepool.llm.minhash import near_duplicates
from tidepool.llm.nbest import decode_pieces, encode_nbest
from tidepool.llm.packing import pack_documents
from tidepool.llm.pii import BASE, find_pii, joined
from tidepool.llm.quality import quality_cascade
from tidepool.llm.tables import documents, shared_path, staged
from tidepool.llm.token_counts import count_tokens
from tidepool.llm.token_files import read_token_files, write_token_files
from tidepool.llm.toxicity import held_out, score_toxicity, train
from tidepool.llm.vector_codes import encode_vectors


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """The conversations as transcripts: each in one of four marker styles, every fifth turn without its marker."""
    role = F.coalesce("role", F.lit("user"))
    said = lambda *names: F.when(role == "system", names[0]).when(role == "assistant", names[2]).otherwise(names[1])
    styles = F.array(said("System: ", "User: ", "Assistant: "), said("Context: ", "Human: ", "AI: "), said("### Instruction:", "### User:", "### Assistant:"), said("[system] ", "[user] ", "[assistant] "))
    marker = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0, "").otherwise(F.element_at(styles, F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int") + 1))
    return conversations.withColumn("text", F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit(""))))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = format_transcripts(raw_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return turns.select(F.col("conv").alias("conv_id"), "turn", "role", "n_lines", "n_begun", F.sha2("rendered", 256).alias("rendered_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), "byte_bpe_50k.json")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf_dir), "word_bpe_49k.json")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, "word_bpe_49k.json")
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _nbest(rows: DataFrame, *ids: str) -> DataFrame:
    found = decode_pieces(encode_nbest(rows, n=4, id_cols=ids))
    decodes = F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")
    return found.select(*ids, "rank", "score", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), decodes.alias("decodes"))


def op5_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nbest(documents(spark, sf_dir), "doc_id")


def op5_nbest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nbest(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality_cascade(documents(spark, sf_dir), measures=base)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *base, failed.alias("base_failed"), "kept")


def _is_kind(name: str):
    return lambda s: s["kind"] == name


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir, "doc_id", "text"))
    of = {name: F.filter("pii", _is_kind(name)) for name in (k.name for k in BASE)}
    base = F.filter("pii", lambda s: s["kind"].isin([k.name for k in BASE]))
    return found.select("doc_id", *(F.size(v).cast("long").alias(f"n_{k}") for k, v in of.items()), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """A twentieth of the rows each: dropped, emptied, without sentence ends, repeated, made a user's."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("damage")).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    rows = rows.withColumns({"text": text, "role": role})
    return rows.withColumn("copy", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def repair_report(conversations: DataFrame) -> DataFrame:
    rows = damaged(conversations)
    found = staged(audits(rows), "audits")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    hashed = repaired_digests(rows, found).select(F.col("conv").alias("hashed"), "repaired_sha256")
    out = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    out = out.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
    # a conversation that lost all rows has no audit
    filled = [F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in counts]
    return out.select("conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_token_counts": op2_token_counts,
    "op3_nearest": op3_nearest,
    "op4_packing": op4_packing,
    "op5_nbest": op5_nbest,
    "op5_nbest_turns": op5_nbest_turns,
    "op6_token_files": op6_token_files,
    "op7_jaccard": op7_jaccard,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_codes": op11_codes,
    "op12_repair": op12_repair,
    "op13_minhash": op13_minhash,
}

ORACLE_SQL: dict[str, str] = {"op7_jaccard": sql.JACCARD, "op9_quality": sql.QUALITY, "op11_codes": sql.VECTOR_CODES, "op12_repair": sql.REPAIR, "op13_minhash": sql.MINHASH}
