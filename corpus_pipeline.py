"""A corpus pipeline of five stages, each one of the language-model operators.

Quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, BPE encoding. A stage
works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.llm.bpe import encode_decode
from plumeline.llm.decontaminate import drop_contaminated
from plumeline.llm.lines import drop_frequent_lines
from plumeline.llm.quality import quality_scores
from plumeline.llm.queries import vocabulary_path
from plumeline.llm.scratch import Scratch
from plumeline.llm.simhash import BROADCAST_ROWS, similar_groups

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _row() -> Column:
    """A document's other columns as one value that goes along with its text: no stage joins on ids that may be null or repeat."""
    return F.struct("doc_id", "lang", "source", "n_chars")


def _documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents from a row and its text."""
    return df.select(F.col("row.doc_id").alias("doc_id"), F.col(text).alias("text"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), F.col("row.n_chars").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject.

    Null and empty texts are scored like any other; repeated rows share a score; without labels no
    document is told from another.
    """
    whole = docs.select("doc_id", "text", _row().alias("row"))
    scored = quality_scores(whole, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry="row")
    return _documents(scored.where("predicted = 1"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in at least 10 of them, with their new length.

    Rows are counted, repeated ones too; a null text becomes empty, as does one that loses all lines.
    """
    kept = drop_frequent_lines(docs.select(_row().alias("row"), "text"), min_docs=10, id_col="row")
    return _documents(kept.withColumnRenamed("doc_id", "row"), "kept").withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of 5-word shingles: the least id.

    A document is known by its id and a hash of its row, so that null and repeated ids are documents
    of their own; of rows that agree in all columns one stays, and null ids give way to others.
    Null and empty texts are one group. Very long texts count whole.
    """
    name = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64(*COLUMNS).alias("h"))
    named = docs.select(name.alias("row_id"), *COLUMNS)
    groups = similar_groups(named, size=5, similarity=0.8, id_col="row_id")
    kinds = groups.groupBy(F.col("doc_id").alias("known")).agg((F.min("component_id") == F.col("doc_id")).alias("stays"), (F.count("*") > 1).alias("many"))
    scratch = Scratch(spark, "near-dedup")
    told = scratch.write(kinds.where("not stays or many"), "told")
    told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told
    kept = named.join(told, F.col("row_id") == F.col("known"), "left").where("coalesce(stays, true)")
    once, repeated = kept.where("not coalesce(many, false)"), kept.where("many")
    return once.select(*COLUMNS).union(repeated.dropDuplicates(["row_id"]).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of 10 words of a benchmark item. Null and empty texts hold none; repeated rows stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left; a null text has no tokens."""
    coded = encode_decode(docs, vocabulary_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL has no quadratic discriminant and no BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is a written table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
