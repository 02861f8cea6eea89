"""The corpus pipeline: toxic documents go, near copies and leaked benchmark items go, personal data get pseudonyms, and
what is left is packed into training sequences.

Every stage works on all that the one before kept, and its result is written as Parquet and read again. Rows are told
apart by a row number that is written with them, not by doc_id, which may be null or repeated; the stages' edge cases
are those of their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import common, decontam, overlap, packing, pii, tokens, toxicity

#: What marks the column of rows' numbers, whatever its name: it is given in the first stage that needs it, and stays with
#: the tables that are written.
MARK = "pipeline row"

#: Pieces in the store of the packing stage's encoder: its workers, stores and all, live on beside later stages and runs.
KEPT_PIECES = 100_000


def row_of(docs: DataFrame) -> str | None:
    """The name of the column of rows' numbers, if there is one; a column of the input is never taken for it."""
    return next((f.name for f in docs.schema.fields if f.metadata.get(MARK)), None)


def with_rows(docs: DataFrame) -> DataFrame:
    """The rows with a number each, in a column whose name the input doesn't have."""
    name, taken = "__row", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return docs.select("*", F.monotonically_increasing_id().alias(name, metadata={MARK: True}))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their numbers, which are read from a table, so they don't change, and the numbers' name."""
    if not row_of(docs):
        docs = common.written(with_rows(docs), "pipeline-rows")
    return docs, row_of(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar's model, learned from the labels, doesn't predict as toxic, with their row numbers."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_rows(docs.where(toxicity.score(model, docs["text"]) < toxicity.THRESHOLD))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id, then row number, of each class of SimHash links and verified overlaps."""
    docs, row = numbered(docs)
    classes = overlap.components(docs.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row")))
    first = docs.select(row, "doc_id").join(classes, row).groupBy("component_id").agg(least.alias("first"))
    return docs.join(first.select(F.col("first.row").alias(row)), row, "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a verified benchmark item."""
    docs, row = numbered(docs)
    found = decontam.matches(docs.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").drop(row)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data, by the session's key or (unset) that of demonstrations."""
    return pii.with_pseudonyms(docs, pii.key_of(spark, pii.DEMONSTRATION_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return packing.packed(docs, tokens.vocabulary(), kept=KEPT_PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pseudonyms", pseudonymise),
    ("packing", pack),
]

#: Token ids of a tokenizer file can't be computed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
