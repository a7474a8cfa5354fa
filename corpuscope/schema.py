"""Canonical issue schema, the severity dimension and the rule message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order of every issue DataFrame produced by the rule operators.
ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType(), False),
        T.StructField("line", T.LongType(), True),
        T.StructField("column", T.LongType(), True),
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("tool", T.StringType(), False),
        T.StructField("code_snippet", T.StringType(), True),
        T.StructField("fingerprint", T.StringType(), True),
    ]
)
ISSUE_COLUMNS = [f.name for f in ISSUE_SCHEMA.fields]

# --- fixed values: severities in declaration order (rank 0 = worst) and their SARIF level ---
SEVERITIES = [
    ("CRITICAL", 0, "error"),
    ("HIGH", 1, "error"),
    ("MEDIUM", 2, "warning"),
    ("WARNING", 3, "note"),
    ("LOW", 4, "note"),
    ("INFO", 5, "note"),
]
# Reverse mapping used when importing SARIF (the forward mapping is lossy).
LEVEL_TO_SEVERITY = {"error": "HIGH", "warning": "MEDIUM", "note": "LOW", "none": "INFO"}

# --- fixed values: rule ids, severities and message templates (reference wording kept) ---
RULE_FILE_TOO_LONG = "N001-FILE-TOO-LONG"
RULE_FILE_LONG = "N002-FILE-LONG"
RULE_MANY_FUNCTIONS = "N003-MANY-FUNCTIONS"
RULE_MANY_METHODS = "N003-MANY-METHODS"
RULE_PARSE_ERROR = "N999-PARSE-ERROR"
RULE_TAINT = "SEC004-TAINT"
RULE_SECRET_PREFIX = "SEC001-"
RULE_ENTROPY = "SEC002-HIGH-ENTROPY"

MSG_FILE_TOO_LONG = "Fichier tres long (%d lignes). Considerer de le diviser."
MSG_FILE_LONG = "Fichier long (%d lignes). Surveiller la complexite."
MSG_MANY_FUNCTIONS = "Nombreuses fonctions (%d) dans un fichier. Considerer de le modulariser."
MSG_MANY_METHODS = "Nombreuses methodes (%d) dans un fichier. Considerer de le modulariser."
MSG_MANY_FUNCS_METHODS = "Nombreuses fonctions/methodes (%d) dans un fichier. Considerer de le modulariser."
MSG_PARSE_ERROR = "Erreur d'analyse: %s"
MSG_TAINT = "Potentiel flux de données sensibles vers un sink détecté."
MSG_SECRET = "Secret potentiellement codé en dur détecté: '%s'"
MSG_ENTROPY = "Chaîne à haute entropie détectée (entropie %.2f)"

TOOL_SEMANTIC = "corpuscope-semantic"
TOOL_TAINT = "corpuscope-taint"
TOOL_SECRETS = "corpuscope-secrets"
TOOL_RULES = "corpuscope-rules"



def severity_rank(col: Column) -> Column:
    """Rank of a severity name (case-insensitive); unknown names rank after INFO."""
    up = F.upper(col)
    expr = F.lit(len(SEVERITIES))
    for name, rank, _ in reversed(SEVERITIES):
        expr = F.when(up == name, F.lit(rank)).otherwise(expr)
    return expr


def sarif_level(col: Column) -> Column:
    """CRITICAL/HIGH -> error, MEDIUM -> warning, everything else -> note."""
    up = F.upper(col)
    return (
        F.when(up.isin("CRITICAL", "HIGH"), F.lit("error"))
        .when(up == "MEDIUM", F.lit("warning"))
        .otherwise(F.lit("note"))
    )


def issue_frame(df: DataFrame) -> DataFrame:
    """Project any DataFrame carrying issue columns onto the canonical column order and types.

    Missing optional columns become typed nulls; extra columns (source, source_ord, run_id...)
    are kept after the canonical ones.
    """
    cols = []
    for f in ISSUE_SCHEMA.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in ISSUE_COLUMNS]
    return df.select(*cols, *extra)
