"""Quality rules whose cutoffs are certified on labelled documents (DataFrame functions only).

For each stratum (language) and rule the tightest cutoff is chosen that provably rejects few good documents:

* a cutoff is tested with the exact binomial tail: if at most ``alpha`` of good documents are rejected, as few
  rejections as observed have probability ``delta`` or less only where the true rate lies below;
* cutoffs of a rule are tested from the loosest on and testing stops at the first failure (fixed sequence, needs no
  correction); strata and rules are corrected for by Bonferroni, and ``alpha`` is split between the rules.

So with probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents to the rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import WORD_GAP, Stages

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: rule -> cutoffs from the loosest to the tightest; a document passes with a value of at most the cutoff
CUTOFFS = {
    "symbol_rate": (0.50, 0.30, 0.20, 0.15, 0.10, 0.05, 0.02),
    "dup_line_rate": (0.90, 0.70, 0.50, 0.40, 0.30, 0.20, 0.10),
    "repeat_rate": (0.50, 0.40, 0.30, 0.20, 0.15, 0.10),
    "word_length": (40.0, 25.0, 18.0, 14.0, 12.0, 10.0, 9.0),
}


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in ``words``: windows are sorted by hash, equal neighbours give
    the places, and the places' gaps the number of words."""

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)
        )

    def of_sorted(s: Column) -> Column:
        near = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return _let(F.array_sort(F.transform(near, lambda x: x["i"])), of_places)

    def of_places(p: Column) -> Column:
        covered = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(covered, F.lit(0), lambda a, x: a + x)

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(hashes, of_hashes))

    return _let(words, of_words)


def quality_features(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("t"))
    words = F.filter(F.split("t", WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = d.select(
        "doc_id", "stratum",
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("rep"))).alias("words"),
    )
    d = d.select("doc_id", "stratum", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), F.col("words.rep").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rule_values() -> dict[str, Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "symbol_rate": ratio("n_symbols", "word_chars"),
        "dup_line_rate": ratio("n_dup_lines", "n_lines"),
        "repeat_rate": ratio("n_repeat_words", "n_words"),
        "word_length": ratio("word_chars", "n_words"),
    }


def most_rejections(n: Column, alpha: float, delta: Column) -> Column:
    """Largest k with ``P(Binomial(n, alpha) <= k) <= delta``, -1 if none: terms are summed in logarithms."""
    odds = math.log(alpha) - math.log1p(-alpha)
    zero = F.struct((n * math.log1p(-alpha)).alias("t"), F.lit(float("-inf")).alias("s"), F.lit(-1).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        s = F.greatest(a["s"], a["t"]) + F.log1p(F.exp(F.least(a["s"], a["t"]) - F.greatest(a["s"], a["t"])))
        t = a["t"] + F.log(F.greatest(n - i, F.lit(1e-300)).cast("double") / (i + 1)) + F.lit(odds)
        return F.struct(t.alias("t"), s.alias("s"), F.when(s <= F.log(delta), i).otherwise(a["k"]).cast("long").alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * alpha)), zero, step)["k"]


def certified_cutoffs(good: DataFrame, alpha: float, delta: float) -> DataFrame:
    """``stratum, rule, cutoff, n, rejected`` from the features of good documents: the tightest cutoff whose test and all
    looser ones passed; rules without one have no row."""
    values = rule_values()
    each = alpha / len(values)
    counts = [F.count(F.lit(1)).alias("n")] + [
        F.count_if(values[r] > c).alias(f"{r}_{i}") for r, cuts in CUTOFFS.items() for i, c in enumerate(cuts)
    ]
    strata = good.groupBy("stratum").agg(*counts)
    strata = strata.crossJoin(strata.agg(F.count(F.lit(1)).alias("strata")))  # one row: the number of strata
    strata = strata.withColumn("most", most_rejections(F.col("n"), each, F.lit(delta) / (F.col("strata") * len(values))))
    tests = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("rejected")) for i, c in enumerate(cuts)]).alias("cuts"))
        for r, cuts in CUTOFFS.items()
    ])
    rows = strata.select("stratum", "n", "most", F.explode(tests).alias("x")).select("stratum", "n", "most", "x.rule", "x.cuts")
    # rejections grow from cutoff to cutoff, so those that pass are a prefix
    passed = F.filter("cuts", lambda c: c["rejected"] <= F.col("most"))
    best = F.get(passed, F.size(passed) - 1)
    return rows.select("stratum", "rule", best["cutoff"].alias("cutoff"), "n", best["rejected"].alias("rejected")).where("cutoff is not null")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, stages: Stages | None = None) -> DataFrame:
    """Features of each document, ``base_failed`` and ``kept``: false if the base rules fail, else whether every certified
    rule of its stratum passes.

    Defined cases: null or empty text has no words and fails the base rules; a null lang is a stratum of its own
    (named ""); a stratum with too few good labelled documents certifies nothing and rejects nothing more; labels that
    repeat a doc_id count once (good only if all say so); labels with nulls or of unknown documents do not count;
    rows that repeat a doc_id are judged each; other columns are not read.
    """
    st = stages or Stages(docs.sparkSession, "quality")
    feats = st.save(quality_features(docs), "features")
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    cuts = certified_cutoffs(feats.where("not base_failed").join(good, "doc_id", "left_semi"), alpha, delta)
    wide = cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in CUTOFFS])
    ok = F.lit(True)
    for r, v in rule_values().items():
        ok = ok & (v <= F.coalesce(F.col(f"max_{r}"), F.lit(float("inf"))))
    out = feats.join(wide, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ok)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "stratum")
