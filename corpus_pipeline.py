"""A corpus pipeline: toxicity filter, near duplicates, repeated passages, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents
(the last one its token counts and digests). ``run`` writes each stage's rows to the shared folder and reads them again.

In every stage: a null text counts as empty (the classifier scores it so, near duplicates and passages find nothing in it);
rows that repeat a doc_id are rows like others, except that rows equal in id and text are one document to the near-duplicate
stage, which keeps one of them; a null doc_id comes last where the smallest is kept; ties are broken by text or a hash of it,
so reruns agree; columns beside those of documents pass through all stages but the last; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoplane.llm import bpe, jaccard, mixing, substring, toxicity
from duoplane.llm.common import staged


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from these documents' labels, doesn't reject."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=True).filter("predicted = 0").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity hold together: that of the smallest doc_id."""
    return jaccard.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in the first document only; n_chars follows the text."""
    done = substring.dedup(docs)
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a row each time; the row that meets a source's budget ends there."""
    mixed = mixing.mix(docs).filter("taken > 0")
    times = mixed.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    part = F.least(F.col("size"), F.col("taken") - F.col("_turn") * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), part.cast("int")), " ")
    whole = part == F.col("size")
    text = F.when(whole, F.col("text")).otherwise(cut)
    return times.withColumns({"text": text, "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length(cut)).cast("long")}).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxicity_stage), ("jaccard_join", near_duplicate_stage), ("substring_dedup", substring_stage), ("mixing", mixing_stage), ("byte_bpe", token_stage)]

#: SQL can't express the classifier, the chunking and the merges. All five stages run together are tested against plain Python,
#: SQL (the mix) and a tokenizer's library over some hundred documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
