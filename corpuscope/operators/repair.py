"""Encoding check (R-8, A-2) and the repair chain (R-9) over a byte corpus.

A byte corpus has ``file STRING, content BINARY``. The chain is: detect -> decode -> entities ->
anchors -> links -> fill empty -> compare. Everything except the two gated Python steps is
native; the input bytes are dropped right after decoding so later stages carry text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.encoding import (
    ACCEPTED_ENCODINGS,
    MIN_CONFIDENCE,
    UNCHANGED_ENCODINGS,
    decode_bytes,
    detect_encoding,
    encoding_problem,
)
from corpuscope.functions.repair import decode_entities, encode_links, fill_empty, fix_anchor_ids
from corpuscope.functions.paths import relative_path
from corpuscope.operators.ordering import ordered_index
from corpuscope.sinks.files import write_documents

# --- fixed values: status texts of the repair report ---
MSG_OK = "ok (déjà conforme)"
MSG_FIXED = "✅ corrigé"
MSG_DRY = "🔧 (dry-run)"
MSG_FAIL = "❌ échec: %s"
MSG_CONTENT = "contenu modifié"
MSG_ENCODING = "encoding:%s(%d%%)→UTF-8"


def check_encoding(corpus: DataFrame, accept=ACCEPTED_ENCODINGS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """S-1 + F-1 per file: ``(file, encoding, confidence, error, is_issue)``."""
    reason = F.col("error") if "error" in corpus.columns else F.lit(None).cast("string")
    det = corpus.select("file", detect_encoding(F.col("content")).alias("d"),
                        F.when(F.col("content").isNull(), F.coalesce(reason, F.lit("contenu illisible"))).alias("error"))
    return det.select(
        "file", "d.encoding", "d.confidence", "error",
        encoding_problem(F.col("encoding"), F.col("confidence"), F.col("error"), accept, min_confidence).alias("is_issue"),
    )


def encoding_issues(checked: DataFrame) -> DataFrame:
    """R-8: problem files with status ERREUR (unreadable) or WARNING."""
    return checked.where("is_issue").select(
        "file", "encoding", "confidence",
        F.when(F.col("error").isNotNull(), F.lit("ERREUR")).otherwise(F.lit("WARNING")).alias("status"),
    )


def encoding_summary(checked: DataFrame) -> DataFrame:
    """A-2: totals and conformity percentages (one decimal), one combinable aggregate."""
    agg = checked.agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if(~F.col("is_issue")).cast("bigint").alias("ok_count"),
        F.count_if(F.col("is_issue")).cast("bigint").alias("issues_count"),
    )
    pct = lambda c: F.round(F.try_divide(F.col(c) * F.lit(100.0), F.col("total")), 1)
    return agg.select("total", "ok_count", "issues_count", pct("ok_count").alias("ok_pct"), pct("issues_count").alias("issues_pct"))


REPORT_TITLE = "RAPPORT DE VERIFICATION D'ENCODAGE UTF-8 - corpuscope"


def encoding_report_lines(checked: DataFrame) -> DataFrame:
    """SNK-3 (text form): header with totals, then one numbered line per problem file in path
    order (numbering by ``ordered_index``)."""
    spark = checked.sparkSession
    s = encoding_summary(checked)
    rule = "=" * 80
    fixed = spark.createDataFrame(
        [(0, 1, rule), (0, 2, REPORT_TITLE), (0, 3, rule), (1, 0, "FICHIERS A CORRIGER"), (1, 1, "-" * 80)],
        "section long, seq long, text string",
    )
    head = s.select(F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("section"), F.lit(4).cast("bigint").alias("seq"),
                 F.format_string("Fichiers analyses: %d", "total").alias("text")),
        F.struct(F.lit(0).cast("bigint").alias("section"), F.lit(5).cast("bigint").alias("seq"),
                 F.format_string("Fichiers conformes: %d (%.1f%%)", "ok_count", F.coalesce("ok_pct", F.lit(0.0))).alias("text")),
        F.struct(F.lit(0).cast("bigint").alias("section"), F.lit(6).cast("bigint").alias("seq"),
                 F.format_string("Fichiers a corriger: %d (%.1f%%)", "issues_count", F.coalesce("issues_pct", F.lit(0.0))).alias("text")),
    )))
    bad = ordered_index(encoding_issues(checked), [F.lower("file"), F.col("file")], name="n")
    body = bad.select(
        F.lit(2).cast("bigint").alias("section"), F.col("n").alias("seq"),
        F.format_string("[%d] Fichier: %s | Encodage: %s | Confiance: %d%% | %s", "n", "file",
                        F.coalesce("encoding", F.lit("inconnu")), F.round(F.col("confidence") * 100).cast("int"), "status").alias("text"),
    )
    return fixed.unionByName(head).unionByName(body)


MD_TITLE = "# Rapport de Vérification d'Encodage UTF-8 - corpuscope"


def encoding_report_markdown(checked: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """SNK-3 (Markdown form): totals, a table of the files to fix (path order), conforming count."""
    spark = checked.sparkSession
    s = encoding_summary(checked)
    fixed = spark.createDataFrame(
        [(0, 1, MD_TITLE), (1, 0, "## ⚠️ Fichiers à corriger"), (1, 1, "| Fichier | Encodage | Confiance | Statut |"),
         (1, 2, "|---------|----------|-----------|--------|")],
        "section long, seq long, text string",
    )

    def line(seq, fmt, *cols):
        return F.struct(F.lit(0).cast("bigint").alias("section"), F.lit(seq).cast("bigint").alias("seq"),
                        F.format_string(fmt, *cols).alias("text"))

    head = s.select(F.inline(F.array(
        line(2, "**Fichiers analysés:** %d", "total"),
        line(3, "**Fichiers conformes:** %d (%.1f%%)", "ok_count", F.coalesce("ok_pct", F.lit(0.0))),
        line(4, "**Fichiers à corriger:** %d (%.1f%%)", "issues_count", F.coalesce("issues_pct", F.lit(0.0))),
    )))
    tail = s.where(F.col("ok_count") > 0).select(
        F.lit(2).cast("bigint").alias("section"), F.lit(0).cast("bigint").alias("seq"),
        F.format_string("%d fichier(s) en UTF-8 avec confiance > %d%%", "ok_count",
                        F.lit(int(round(min_confidence * 100)))).alias("text"),
    )
    bad = ordered_index(encoding_issues(checked), [F.lower("file"), F.col("file")], name="n")
    name = F.regexp_extract(F.col("file"), "([^/]*)$", 1)
    rows = bad.select(
        F.lit(1).cast("bigint").alias("section"), (F.col("n") + 2).alias("seq"),
        F.format_string("| `%s` | %s | %d%% | %s |", name, F.coalesce("encoding", F.lit("inconnu")),
                        F.round(F.col("confidence") * 100).cast("int"),
                        F.when(F.col("status") == "ERREUR", F.lit("❌ ERREUR")).otherwise(F.lit("⚠️ WARNING"))).alias("text"),
    )
    return fixed.unionByName(head).unionByName(rows).unionByName(tail)


def repair(corpus: DataFrame, dry_run: bool = True) -> DataFrame:
    """R-9 over ``(file, content)``: ``(file, encoding, confidence, success, changed, message,
    dry_run, text_before, text_after)``.

    ``text_before`` is the decoded original (the ``--backup`` copy); ``text_after`` is what SNK-4
    writes (UTF-8 without BOM). Files whose repair failed keep ``text_after`` null.
    """
    # a file that could not be read is a failure, with the reader's reason where it gives one
    reason = F.col("error") if "error" in corpus.columns else F.lit(None).cast("string")
    unread = F.when(F.col("content").isNull(), F.coalesce(reason, F.lit("contenu illisible")))
    det = corpus.select("file", "content", unread.alias("unread"), detect_encoding(F.col("content")).alias("d"))
    dec = det.select(
        "file", "unread", F.col("d.encoding").alias("encoding"), F.col("d.confidence").alias("confidence"),
        decode_bytes(F.col("content"), F.col("d.encoding")).alias("x"),
    ).select(
        "file", "unread",
        F.when(F.col("x.fallback"), F.lit("utf-8 (fallback)")).otherwise(F.col("encoding")).alias("encoding"),
        F.when(F.col("x.fallback"), F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.col("x.text").alias("text_before"),
    )
    ent = dec.withColumn("e", decode_entities(F.col("text_before")))
    anchors = ent.withColumn("t1", fix_anchor_ids(F.col("e.text")))
    links = anchors.withColumn("t2", encode_links(F.col("t1")))
    out = links.select(
        "file", "encoding", "confidence", "text_before",
        F.coalesce("unread", F.col("e.error")).alias("error"),
        fill_empty(F.col("t2")).alias("text_after"),
    )
    enc_changed = F.coalesce(~F.lower(F.col("encoding")).isin(list(UNCHANGED_ENCODINGS)), F.lit(False))
    content_changed = F.coalesce(F.col("text_after") != F.col("text_before"), F.lit(False))
    changed = enc_changed | content_changed
    details = F.array_compact(F.array(
        F.when(enc_changed, F.format_string(MSG_ENCODING, F.coalesce("encoding", F.lit("None")),
                                            F.round(F.col("confidence") * 100).cast("int"))),
        F.when(content_changed, F.lit(MSG_CONTENT)),
    ))
    status = MSG_DRY if dry_run else MSG_FIXED
    message = (
        F.when(F.col("error").isNotNull(), F.format_string(MSG_FAIL, "error"))
        .when(~changed, F.lit(MSG_OK))
        .otherwise(F.format_string("%s [%s]", F.lit(status), F.array_join(details, ", ")))
    )
    return out.select(
        "file", "encoding", "confidence",
        F.col("error").isNull().alias("success"),
        F.when(F.col("error").isNull(), changed).otherwise(F.lit(False)).alias("changed"),
        message.alias("message"),
        F.lit(dry_run).alias("dry_run"),
        "text_before",
        F.when(F.col("error").isNull(), F.col("text_after")).alias("text_after"),
    )


def write_repaired(repaired: DataFrame, path: str, partition_col: str | None = None, mode: str = "errorifexists") -> None:
    """SNK-4: write changed files (UTF-8, no BOM) to a new location; inputs are never overwritten.
    Dry runs write nothing: use the ``repair`` DataFrame itself as the diff."""
    rows = repaired.where(F.col("changed") & ~F.col("dry_run")).select("file", F.col("text_after").alias("text"), *(
        [partition_col] if partition_col else []))
    w = rows.write.mode(mode)
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)


def write_repaired_files(repaired: DataFrame, folder: str, root: str, backup: bool = False, every: bool = False) -> DataFrame:
    """SNK-4 as files: each changed document (``every``: each that has a text) below ``folder`` at its path relative to
    ``root``, UTF-8 without BOM, with ``<name>.bak`` beside it if ``backup``. Returns the manifest; a dry run and failed
    repairs write nothing. Files outside ``root`` keep their name only."""
    rows = repaired.where(~F.col("dry_run") & F.col("success"))
    if not every:
        rows = rows.where("changed")
    name = relative_path(F.col("file"), root).alias("name")
    old = F.col("text_before") if backup else F.lit(None).cast("string")
    return write_documents(rows.select(name, F.col("text_after").alias("content"), old.alias("backup")), folder)
