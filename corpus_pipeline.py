"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that it keeps, with their columns; the last returns
how often each document is taken. Rows with nulls, empty texts and repeated rows pass or go as the operators define;
other columns are carried whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import Stages, row_key
from corpuscope.llm.decontaminate import drop_leaks
from corpuscope.llm.jaccard_join import near_duplicate_components
from corpuscope.llm.mixing import mix_sources
from corpuscope.llm.suffix_dedup import suffix_dedup
from corpuscope.llm.toxicity import drop_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar predicts toxic go."""
    return drop_toxic(docs, _table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest id (rows without one last), and of rows equal
    in id and text the first by its other columns. Rows are told apart by id and text, so a shared or missing id drops
    nothing else. Rows without words stay."""
    stages = Stages(spark, "near-duplicates")
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = docs.toDF(*names).withColumn("row", row_key(F.col(doc_id), F.col(text)))
    found = near_duplicate_components(plain.select(F.col("row").alias("doc_id"), F.col(text).alias("text")), stages=stages)
    groups = stages.save(found.select(F.col("doc_id").alias("row"), "component_id", "n_shingles"), "groups")
    ids = plain.groupBy("row").agg(F.min(F.col(doc_id).cast("long")).alias("id"), F.count(F.lit(1)).alias("times"))
    worded = groups.where("n_shingles > 0").select("row", "component_id").distinct().join(ids, "row")
    first = worded.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row", "times")).alias("m"))
    chosen = stages.save(first.select("m.row", (F.col("m.times") > 1).alias("repeated")), "chosen")
    wordless = groups.where("n_shingles = 0").select("row", F.lit(False).alias("repeated")).distinct()
    kept = plain.join(chosen.union(wordless), "row")
    one = kept.where("repeated").groupBy("row").agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("r")).select("r.*")
    return kept.where("not repeated").select(names).union(one.select(names)).toDF(*docs.columns)


def suffix_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes of 100-byte strings that an earlier document, or place, has; ``n_chars`` follows."""
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    out = suffix_dedup(docs.toDF(*names))
    back = []
    for c, n in zip(docs.columns, names):
        col = F.col("kept_text") if c == "text" else F.length("kept_text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(n)
        back.append(col.alias(c))
    return out.select(back)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_cut),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

ORACLE_SQL = None  # stages learn from labels and cluster texts: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, all stages applied to ``documents``."""
    stages = Stages(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stages.save(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
