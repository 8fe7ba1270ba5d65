"""Queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import bpe, chat, decontam, langid, lexical, phrases, pii, records, shards, simhash, topk, toxicity, whitening
from timberline.llm.tables import bounded_sample, fold, table


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; ``TIMBERLINE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("TIMBERLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    known = labels.filter(~held & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # one row an id, and about MAX_TRAIN_DOCS of them at most: small enough to send everywhere
    model = toxicity.learn(docs.join(F.broadcast(bounded_sample(known, toxicity.MAX_TRAIN_DOCS)), "doc_id"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(fold("doc_id", 3) != 1))
    marked = langid.identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return marked.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.rotate(table(spark, sf_dir, "conversations")))


def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup_phrases(table(spark, sf_dir, "documents"), digest=True)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = decontam.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        "longest",
        "longest_at",
        "longest_item",
    )


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.write_and_read(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.numbered(table(spark, sf_dir, "documents"), shards.Tree.even(shards.SHARDS))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_topk": op3_topk,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_chat": op6_chat,
    "op7_phrases": op7_phrases,
    "op8_decontamination": op8_decontamination,
    "op9_records": op9_records,
    "op10_simhash": op10_simhash,
    "op11_shards": op11_shards,
    "op12_whitening": op12_whitening,
    "op13_lexical": op13_lexical,
}

#: DuckDB's text for those that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_topk": """
WITH valid AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op6_chat": chat.SQL,
    "op11_shards": shards.SQL,
    "op13_lexical": lexical.SQL,
}
