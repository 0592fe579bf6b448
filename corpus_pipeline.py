"""A training-corpus pipeline over `documents`: language ID, near-dedup, decontamination, personal data, packing.

Each stage gets the documents its predecessor kept and returns those it keeps, with the columns of documents and its
decisions in them; the last returns packed pieces. Between stages the rows are written as Parquet and read again.

Defined results: every stage takes nulls, empty tables, repeated rows and further columns as its operator does; n_chars,
where there is such a column, is set to the text's length again after a stage that changes texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trimodel.llm import decontaminate, language_id, packing, pii, simhash
from trimodel.llm.common import discard, free, prepare, written
from trimodel.llm.queries import table, tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go; `lang` is the predicted one."""
    model = language_id.fit(docs)
    found, score = free(docs, "tm_lang", "tm_score")
    out = language_id.predicted(docs, model, lang_name=found, score_name=score)
    kept = out.where(F.col(found) != "und") if model is not None else out.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    lang = F.when(F.col(found) == "und", F.col("lang")).otherwise(F.col(found))
    return kept.withColumn("lang", lang).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, a similarity of 0.8 or more."""
    return simhash.without_similar(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document that has nothing else goes."""
    return _counted(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised."""
    return _counted(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("pii", sanitise_personal_data),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir))
        discard(spark, docs)  # the stage before is read by nobody any more
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
