"""Secret scanning entry points (R-5 + R-7) and confidence scoring (X-7)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.entropy import shannon_entropy
from corpuscope.functions.lines import splitlines
from corpuscope.functions.text import any_regex
from corpuscope.operators.scan import (
    DEFAULT_ENTROPY_THRESHOLD,
    DEFAULT_SECRET_PATTERNS,
    EntropyRule,
    SecretPattern,
    SecretPatternRule,
    secret_places,
    scan,
)


def scan_secrets(corpus: DataFrame, entropy_threshold: float = DEFAULT_ENTROPY_THRESHOLD,
                 exclude_regex: str | None = None,
                 patterns: Sequence[SecretPattern] = DEFAULT_SECRET_PATTERNS, every: bool = True) -> DataFrame:
    """Pattern and entropy issues in one pass; both are emitted when both hit a line, for every match or the first.
    ``exclude_regex`` (see ``sources.globs.globs_to_regex``) drops files by path first."""
    if exclude_regex:
        corpus = corpus.where(~F.col("file").rlike(exclude_regex))
    return scan(corpus.select("file", "text"), [SecretPatternRule(list(patterns), every), EntropyRule(entropy_threshold, every=every)])


# --- fixed values: safe contexts from the roadmap (a hit inside one is not a secret): the
# generic list, then the per-language request accessors (PHP, JavaScript, Python) ---
SAFE_CONTEXTS = [
    r"""\$_POST\[['"](password|passwd)['"]""",
    r"""\$password\s*=\s*\$_""",
    r"""function.*\(\$password\)""",
    r"""'password'\s*=>\s*\$""",
    r"""\$_GET\[['"]password['"]\]""",
    r"""req\.body\.password""",
    r"""formData\.password""",
    r"""request\.form\[['"]password['"]\]""",
]


def secret_confidence(corpus: DataFrame, hit_patterns: Sequence[str], low_patterns: Sequence[str],
                      high_patterns: Sequence[str], safe_contexts: Sequence[str] = SAFE_CONTEXTS) -> DataFrame:
    """X-7: candidate lines minus safe contexts, with a confidence score and band.

    Score 90 when a high-confidence shape is on the line, else 20 when a low-confidence context
    is, else 50. Bands: [0,30) probable false positive, [30,70) to verify, [70,100] likely.
    """
    hit = any_regex(hit_patterns, flags="")
    safe = any_regex(safe_contexts, flags="")
    numbered = F.transform(splitlines(F.col("text")), lambda l, i: F.struct((i + 1).alias("line"), l.alias("text")))
    gated = F.filter(numbered, lambda x: x["text"].rlike(hit))
    cand = (
        corpus.select("file", F.explode(gated).alias("x"))
        .select("file", F.col("x.line").cast("bigint").alias("line"), F.col("x.text").alias("text"))
        .where(~F.col("text").rlike(safe))
    )
    score = (
        F.when(F.col("text").rlike(any_regex(high_patterns, flags="")), F.lit(90))
        .when(F.col("text").rlike(any_regex(low_patterns, flags="")), F.lit(20))
        .otherwise(F.lit(50))
    )
    band = F.when(score < 30, F.lit("probable_false_positive")).when(score < 70, F.lit("to_verify")).otherwise(F.lit("likely"))
    return cand.select("file", "line", score.cast("bigint").alias("confidence"), band.alias("band"))


# --- ours: what makes a value look like a real secret, in points ---
BASE_POINTS, ENTROPY_POINTS, LONG_POINTS = 30, 10, 10  # entropy counts up to four bits a character
PLACEHOLDER_POINTS, COMMENT_POINTS, FORM_POINTS, TEST_POINTS = -40, -20, -30, -20
LONG_VALUE = 20
PLACEHOLDER = r"(?i)^(?:password|passwd|secret|token|api[_-]?key|private[_-]?key|changeme|example|test|none|null|todo|x+|\*+|[<${%].*)$"
COMMENT = r"^\s*(?:#|//|/\*|\*|<!--|--)"
FORM = r"(?i)<(?:input|label|form|select|textarea)\b"
TEST_PATH = r"(?i)(?:^|[/_.-])(?:tests?|spec|fixtures?|examples?)(?:[/_.-]|$)"


def secret_scores(corpus: DataFrame, patterns: Sequence[SecretPattern] = DEFAULT_SECRET_PATTERNS,
                  safe_contexts: Sequence[str] = SAFE_CONTEXTS) -> DataFrame:
    """X-7 from context, entropy and position: ``file, line, column, rule, entropy, confidence, band`` of every secret that
    the patterns find outside safe contexts.

    The entropy is that of the value, not of the keyword; a value that is a keyword, a variable or a filler loses points,
    and so do comments, HTML form fields and test paths."""
    safe = any_regex(safe_contexts, flags="")
    anywhere = any_regex([p.regex for p in patterns], flags="")
    numbered = F.transform(splitlines(F.col("text")), lambda l, i: F.struct((i + 1).alias("line"), l.alias("text")))
    lines = corpus.select("file", F.explode(F.filter(numbered, lambda x: x["text"].rlike(anywhere) & ~x["text"].rlike(safe))).alias("x"))

    def named(p: SecretPattern):
        return F.transform(secret_places(F.col("x.text"), p), lambda w: F.struct(F.lit(p.name).alias("rule"), w["start"].alias("start"), w["length"].alias("length")))

    found = F.flatten(F.array(*[named(p) for p in patterns]))
    hits = lines.select("file", F.col("x.line").cast("bigint").alias("line"), F.col("x.text").alias("text"), F.explode(found).alias("w"))
    hits = hits.withColumn("value", F.col("text").substr(F.col("w.start"), F.col("w.length")))
    hits = hits.withColumn("entropy", F.round(shannon_entropy(F.col("value")), 6))

    def points(when, n: int):
        return F.when(when, n).otherwise(0)

    score = (
        F.lit(BASE_POINTS) + F.round(F.least(F.col("entropy"), F.lit(4.0)) * ENTROPY_POINTS).cast("int") + points(F.length("value") >= LONG_VALUE, LONG_POINTS)
        + points(F.col("value").rlike(PLACEHOLDER), PLACEHOLDER_POINTS) + points(F.col("text").rlike(COMMENT), COMMENT_POINTS)
        + points(F.col("text").rlike(FORM), FORM_POINTS) + points(F.col("file").rlike(TEST_PATH), TEST_POINTS)
    )
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint")
    out = hits.select("file", "line", F.col("w.start").cast("bigint").alias("column"), F.col("w.rule").alias("rule"), "entropy", clamped.alias("confidence"))
    band = F.when(F.col("confidence") < 30, "probable_false_positive").when(F.col("confidence") < 70, "to_verify").otherwise("likely")
    return out.withColumn("band", band)
