"""Queries of this package: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.byte_tree import encode_bytes
from bazaarlens.llm.grid_order import near_duplicates
from bazaarlens.llm.language_bloom import fit_languages, identify_language
from bazaarlens.llm.page_consensus import extract_main_text
from bazaarlens.llm.pii_crf import KINDS, find_private
from bazaarlens.llm.piece_codec import encode_pieces
from bazaarlens.llm.quality_cotrain import fit_quality, score_quality
from bazaarlens.llm.template_leaks import find_leaks
from bazaarlens.llm.token_groups import jaccard_components
from bazaarlens.llm.tool_calls import format_tool_calls
from bazaarlens.llm.toxicity import fit_toxicity, is_held_out, score_toxicity
from bazaarlens.llm.turn_repair import repair_turns, summarise
from bazaarlens.llm.word_runs import word_runs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model_path() -> str:
    """Place of the public vocabulary; it is read where it is installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model_path() -> str:
    """Place of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked calls and results of every conversation, validated, as canonical JSON; -1: no such turn."""
    found = format_tool_calls(table(spark, sf_dir, "conversations"))
    return found.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("call_turn", "result_turn")})


OP1_SQL = """
WITH calls AS (
  SELECT conv_id, turn, CAST(turn AS VARCHAR) AS call_id,
         CASE role WHEN 'user' THEN 'reply' ELSE 'instruct' END AS name, text,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE role WHEN 'user' THEN 'reply' ELSE 'instruct' END, text) AS nth,
         count(*) OVER (PARTITION BY conv_id, turn) AS n_calls
  FROM conversations WHERE role IN ('user', 'system')
), results AS (
  SELECT conv_id, turn, CAST(turn - 1 AS VARCHAR) AS call_id, text,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth,
         count(*) OVER (PARTITION BY conv_id, turn) AS n_results
  FROM conversations WHERE role = 'assistant'
), both_sides AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.name,
         c.turn AS call_turn, r.turn AS result_turn, c.text AS asked, r.text AS answer,
         coalesce(c.n_calls, 0) AS n_calls, coalesce(r.n_results, 0) AS n_results
  FROM (SELECT * FROM calls WHERE nth = 1) c FULL JOIN (SELECT * FROM results WHERE nth = 1) r
    ON c.conv_id = r.conv_id AND c.call_id = r.call_id
), told AS (
  SELECT *, CASE WHEN n_calls = 0 THEN 'orphan' WHEN n_results = 0 THEN 'unanswered' ELSE 'linked' END AS status FROM both_sides
)
SELECT conv_id, call_id, name, coalesce(call_turn, -1) AS call_turn, coalesce(result_turn, -1) AS result_turn,
       coalesce(call_turn, result_turn) AS place, 0 AS level, status, n_calls, n_results, CASE WHEN n_calls > 0 AND asked IS NULL THEN 'missing text' ELSE '' END AS errors,
       CAST(json_object('arguments', CASE WHEN n_calls = 0 THEN NULL WHEN asked IS NULL THEN json_object('turn', call_turn)
                                     ELSE json_object('text', asked, 'turn', call_turn) END,
                        'id', call_id, 'name', name, 'result', answer, 'status', status) AS VARCHAR) AS canonical_json
FROM told
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of the held-out fold are never learned from."""
    documents = table(spark, sf_dir, "documents")
    model = fit_toxicity(documents, table(spark, sf_dir, "labels"))
    return score_toxicity(documents, model).select(
        "doc_id",
        is_held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return encode_pieces(table(spark, sf_dir, "documents"), piece_model_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = find_private(table(spark, sf_dir, "documents"))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the held-out fold is never learned from."""
    documents = table(spark, sf_dir, "documents")
    return identify_language(documents, fit_languages(documents)).select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the winning container paths of its host."""
    return extract_main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views and their combination; kept is score >= 0.5."""
    documents = table(spark, sf_dir, "documents")
    model = fit_quality(documents, table(spark, sf_dir, "labels"))
    return score_quality(documents, model).select(
        "doc_id",
        is_held_out("doc_id").alias("held_out"),
        "content_score",
        "metadata_score",
        "score",
        (F.col("score") >= 0.5).alias("kept"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items, one row for each document and item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal label with a cosine of 0.98 or more: links, components and the kept one."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def with_periods(documents: DataFrame) -> DataFrame:
    """doc_id and text, where the text of one id in ten repeats a block of its words to its end.

    h = crc32(doc_id), g = h div 10: with h % 10 = 0, word i >= a becomes word a + (i - a) % p, where
    a = g % n and p = 1 + (n - a) div (3 + g % 8). Rows without doc_id or words stay as they are.
    """
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = documents.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n = F.size("words").cast("long")
    g = F.expr("h div 10")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    block = F.slice("words", (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    whole = F.concat(F.slice("words", F.lit(1), a.cast("int")), F.flatten(F.array_repeat(block, times)))
    periodic = F.array_join(F.slice(whole, F.lit(1), n.cast("int")), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), periodic).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document: their number, the one with the greatest exponent, and digests."""
    found = word_runs(with_periods(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def greater(best, x):
        more = x["length"] * best["period"] > best["length"] * x["period"]
        return F.when(best.isNull() | more, x).otherwise(best)

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.reduce("runs", none, greater)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the byte-level ids and of the decoded text of every document."""
    return encode_bytes(table(spark, sf_dir, "documents"), byte_model_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with one fault in five of twenty rows, by crc32 of conv_id:turn; nulls are one space there."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key) % 20).alias("kind"),
    )
    return rows.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least repair cost, audit and digest of the repaired turns of every damaged conversation."""
    conversations = table(spark, sf_dir, "conversations")
    found = summarise(repair_turns(damaged(conversations), copies="copies")).withColumnRenamed("conv_id", "found_id")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES = {
    "op1_chat": op1_chat,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_pii": op4_pii,
    "op5_language": op5_language,
    "op6_html": op6_html,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_embeddings": op9_embeddings,
    "op10_jaccard": op10_jaccard,
    "op11_runs": op11_runs,
    "op12_bytes": op12_bytes,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {"op1_chat": OP1_SQL}
