"""Mix sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import WORD, Stages
from corpuscope.operators.ordering import ordered_index

BUCKET_DIGITS = 3  # hex digits of the seeded order that name a bucket: 4096 for each source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, epochs: float) -> DataFrame:
    """``sources`` (``source, source_size, weight``) with ``target``: shares of ``budget`` by weight, clamped at
    ``epochs`` times the size; the excess goes to the others by weight until none is above.

    Sources whose ``cap / weight`` is at most the level are clamped; each round raises the level, so rounds end when no
    source joins them. The driver sees two sums a round.
    """
    t = sources.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    level, before = 0.0, -1.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        used, free = t.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free or level == before:
            break
        before, level = level, max(level, (budget - used) / free)
        if level == before:
            break
    return t.withColumn("target", F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))).drop("cap")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 7, stages: Stages | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, whole, part`` for each input row.

    ``size`` is the number of words. Sources in code point order (null last) weigh ``weights``, repeated; together they
    take ``share`` times all words, no source over ``epochs`` times its size (``water_fill``). Every document of a
    source is taken ``whole`` times; the rest of the target goes once more through the source in a seeded order, and
    the last document reached gives only its first words (``part`` = words of the additional repetition).

    The order is cut to 4096 buckets for each source, summed where the rows are; only documents of the one bucket in
    which the target ends are ordered one by one, so no task sees a whole source.

    Defined cases: null or empty text has size 0 and takes 0; a null source is a source; an empty table gives no rows;
    a null doc_id is ordered as an empty one; rows repeated in all are taken in any order among themselves, with the same
    set of results on each run; other columns are not read.
    """
    spark = docs.sparkSession
    st = stages or Stages(spark, "mix")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = st.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), order.alias("o")),
        "sized",
    )
    bucket = F.substring("o", 1, BUCKET_DIGITS).alias("b")
    buckets = st.save(sized.groupBy("source", bucket).agg(F.sum("size").alias("words")), "buckets")
    sums = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = ordered_index(sums, [F.col("source").asc_nulls_last()], name="i")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = st.save(ranked.select("source", "source_size", pick.alias("weight")), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(ranked, share * total, epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    along = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        buckets.withColumn("upto", F.sum("words").over(along))  # at most 4096 rows for a source
        .join(targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where(F.col("upto") > F.col("rest")).groupBy("source")
        .agg(F.min_by(F.struct("b", (F.col("upto") - F.col("words")).alias("before")), "b").alias("end"))
        .select(F.col("source").alias("s"), "end.b", "end.before")
    )
    plan = st.save(
        targets.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("source").alias("s"), "source_size", "target", "whole", "rest", F.coalesce("b", F.lit("g")).alias("end"), F.coalesce("before", F.lit(0)).alias("before")),
        "plan",
    )
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("b", bucket)
    inside = Window.partitionBy("s").orderBy("o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where(F.col("b") == F.col("end")).withColumn(
        "part", F.floor(F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))).cast("long")
    )
    last = last.withColumn("part", F.greatest(F.lit(0), F.least("part", "size")).cast("long"))
    others = rows.where(F.col("b") != F.col("end")).withColumn("part", F.when(F.col("b") < F.col("end"), F.col("size")).otherwise(0).cast("long"))
    return last.unionByName(others).select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "whole", "part"
    )
