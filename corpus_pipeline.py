"""The corpus pipeline: five stages, each a function of (spark, docs, sf_dir).

Each stage works on all that its predecessor kept, and all but the last return the
columns of ``documents``:

1. toxicity: documents whose score reaches their language's threshold go;
2. language: documents without letters go, and those of some length that no learned
   language fits; a short text on which languages tie stays;
3. near_duplicates: one document of each group stays;
4. decontamination: documents that contain a benchmark item go;
5. sentencepiece: the rest is encoded and decoded (n_tokens, digests).

``docs`` are any documents with these columns; nulls, empty texts and empty tables pass
through as the operators define: a null or empty text has no language and goes in stage
2, rows that share a doc_id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescriva.llm import decontamination, language, pieces, shared, toxicity, weighted_minhash

#: Phrases for 100 letters, in the language that fits best, above which a text of LONG letters is in none; texts of learned languages have 17, the least usual of them 50.
MOST_PHRASES, LONG = 60, 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from those of the labelled documents that are in ``docs``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("not flagged").select(docs.columns)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without any labelled row nothing can be told, and all stay."""
    model = language.fit(docs)
    if model is None:
        return docs
    named = language.identify(docs, model)
    fits = (F.col("lang_rate") <= MOST_PHRASES) | (F.length("text") < LONG)
    return named.where((F.col("lang_pred") != "und") & fits).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weighted_minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(docs, public_tokenizers.path(pieces.MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL expresses neither the trained models nor the sampling; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
