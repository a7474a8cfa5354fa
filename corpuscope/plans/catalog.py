"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the driver's whole tables.

Parameters are chosen so the rules fire on the generated data (the tables are prose and HTML,
not code); they are part of the query definition and mirrored exactly in ``plans/oracle.py``.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import schema as S
from corpuscope.functions.lines import count_newline_lines, split_newline, splitlines
from corpuscope.functions.text import any_regex, contains_any
from corpuscope.operators import summary, taint
from corpuscope.operators.scan import (
    DefinitionCountRule,
    DefinitionSpec,
    EntropyRule,
    FileLengthRule,
    LineRule,
    LineRulesRule,
    SecretPattern,
    SecretPatternRule,
    TaintRule,
    complexity_proxy,
    detect_language,
    file_metrics,
    parse_errors,
    scan,
)
from corpuscope.operators import fuse as FU
from corpuscope.operators.secrets import secret_confidence
from corpuscope.sinks import reports as RP
from corpuscope.sinks import sarif as SR
from corpuscope.sources import sarif as SRC_SARIF
from corpuscope.sources.tables import documents_corpus, pages_corpus, table

# --- query parameters (mirrored in plans/oracle.py) ---------------------------------------------
TAINT_SENSITIVE = [r"\d+\.\d+\.\d+\.\d+", "token"]
TAINT_ENTRIES = ["License", " and "]
TAINT_SINKS = [" of "]

FLAGSHIP_SENSITIVE = [r"[\w.]+@[\w.]+"]
FLAGSHIP_ENTRIES = [" and "]
FLAGSHIP_SINKS = [" of "]

DOC_LENGTHS = {"en": (40, 20), "fr": (30, 15), "de": (40, 20), "es": (50, 25)}
PAGE_LINKS = {"html": DefinitionSpec(r"(?i)<a\s", 5, S.RULE_MANY_FUNCTIONS, S.MSG_MANY_FUNCTIONS)}
MAX_BYTES = 16384
SECRET_RULES = [SecretPattern("token", r'(token)\s*=\s*"([A-Za-z0-9_]+)"', 2)]
ENTROPY_THRESHOLD = 3.5
CUSTOM_RULES = [
    LineRule("CUSTOM-TOKEN", r"token\s*=", "CRITICAL", "Affectation de jeton"),
    LineRule("CUSTOM-LICENSE", r"[Ll]icen[sc]e", "INFO", "Mention de licence"),
    LineRule("CUSTOM-EMAIL", r"@mail", "MEDIUM", "Adresse e-mail"),
]
SONAR_OF = {"CRITICAL": "BLOCKER", "MEDIUM": "ODD", "INFO": "INFO"}  # severities of the custom rules as Sonar's
CODE_OF = {" of ": " eval(", " la ": " strcpy(", " und ": " reflect."}  # joining words as calls
PROGRAM_OF = {"en": "python", "fr": "cpp", "de": "go", "es": "ruby"}
IMPORT_LEVELS = ["error", "note", None]  # default levels of the custom rules; the last has none
IMPORT_SPLIT = 1500
TABLE_LANGS = [None, "en", "FR"]  # of the custom rules in the rule table
CONFIDENCE_HIT = [r"token|\d+\.\d+\.\d+"]
CONFIDENCE_LOW = ["License"]
CONFIDENCE_HIGH = [r"[0-9a-f]{40}"]
TOP_K = 10
SEVERITY_THRESHOLD = "medium"
RULES_META = {
    "SEC004-TAINT": {"name": "TaintFlow", "description": "Sensitive data reaches a sink",
                     "help_uri": "https://example.org/rules/taint"},
    "SEC001-token": {"name": "HardcodedToken", "description": "Token assigned in clear text"},
}
SARIF_RUN_SIZE = 100
# Events used as a timestamped issue feed: event type -> severity (ours).
EVENT_SEVERITY = {"error": "CRITICAL", "purchase": "HIGH", "signup": "MEDIUM", "click": "LOW", "view": "INFO"}
RELATIVE_ROOT = "https://"
# Byte corpus derived from documents: these repositories are stored in Latin-1 / with a BOM.
LATIN1_REPOS = ["src3", "src7", "src11"]
BOM_REPOS = ["src5"]
DUP_K = 3
CHUNK_BYTES = 1024
WAVE_SPLIT = "src2"
PATH_GLOBS = ["src1*/1*.md", "*/2?.md"]
EXCLUDE_GLOBS = ["src1/*", "src1?/*"]
PAGE_SUFFIX = ".HTML"
TREND_WINDOW = "1 day"
SECRET_EXCLUDE = ["src1*/*"]
# Event feed of the streaming queries: a batch is eight days of events, the last takes the rest; one event of twenty comes
# a batch late. The watermark is a day behind.
FEED_DAYS, FEED_LAST, FEED_LATE = 8, 3, 20
FEED_WATERMARK = "1 day"
# stand-alone check variant: ASCII is not accepted, higher confidence required
STRICT_ACCEPT = ("UTF-8", "UTF8")
STRICT_MIN_CONFIDENCE = 0.8


def docs(spark, sf):
    return documents_corpus(spark, sf)


def all_issue_rules():
    return [
        FileLengthRule(DOC_LENGTHS),
        SecretPatternRule(SECRET_RULES, every=False),
        EntropyRule(ENTROPY_THRESHOLD, every=False),
        TaintRule(TAINT_SENSITIVE, TAINT_ENTRIES, TAINT_SINKS),
        LineRulesRule(CUSTOM_RULES),
    ]


def q_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """P-2: lines per file with ``split('\\n')``."""
    return docs(spark, sf).select("file", F.size(split_newline(F.col("text"))).cast("bigint").alias("n_lines"))


def q_splitlines_count(spark: SparkSession, sf: str) -> DataFrame:
    """P-3: lines per file with ``splitlines()`` semantics."""
    return docs(spark, sf).select("file", F.size(splitlines(F.col("text"))).cast("bigint").alias("n_lines"))


def q_taint_flow(spark, sf):
    return taint.taint_flow(docs(spark, sf), TAINT_SENSITIVE, TAINT_ENTRIES, TAINT_SINKS)


def q_taint_flow_window(spark, sf):
    return taint.taint_flow(docs(spark, sf), TAINT_SENSITIVE, TAINT_ENTRIES, TAINT_SINKS, form="window")


def q_taint_flagship(spark, sf):
    return taint.taint_flow(docs(spark, sf), FLAGSHIP_SENSITIVE, FLAGSHIP_ENTRIES, FLAGSHIP_SINKS)


def q_long_files(spark, sf):
    return scan(docs(spark, sf), [FileLengthRule(DOC_LENGTHS)])


def q_many_definitions(spark, sf):
    return scan(pages_corpus(spark, sf), [DefinitionCountRule(PAGE_LINKS, lang="html")])


def q_parse_errors(spark, sf):
    return parse_errors(docs(spark, sf), MAX_BYTES)


def q_secret_patterns(spark, sf):
    return scan(docs(spark, sf), [SecretPatternRule(SECRET_RULES, every=False)])


def q_secret_entropy(spark, sf):
    return scan(docs(spark, sf), [EntropyRule(ENTROPY_THRESHOLD, every=False)])


def q_custom_rules(spark, sf):
    return scan(docs(spark, sf), [LineRulesRule(CUSTOM_RULES)])


def q_rule_table(spark, sf):
    """R-6, F-7 from a table: a rule for the first four words of each benchmark item, and rules of one language."""
    from corpuscope.operators.rule_table import scan_rule_table

    bench = table(spark, sf, "benchmark")
    head = F.regexp_extract("text", r"^([A-Za-z]+ [A-Za-z]+ [A-Za-z]+ [A-Za-z]+)", 1)
    rules = bench.select(F.concat(F.lit("ITEM-"), F.col("item_id").cast("string")).alias("rule_id"), head.alias("pattern"), F.lit(None).cast("string").alias("lang"),
                         F.lit("HIGH").alias("severity"), F.lit("Passage de test").alias("message")).where("pattern <> ''")
    own = [(r.rule_id, r.pattern, lang, r.severity, r.message) for r, lang in zip(CUSTOM_RULES, TABLE_LANGS)]
    return scan_rule_table(docs(spark, sf), rules.union(spark.createDataFrame(own, rules.schema)))


def q_all_issues(spark, sf):
    """U-1: every rule over documents in one pass (one read, one split per file)."""
    return scan(docs(spark, sf), all_issue_rules())


def q_semantic_scan(spark, sf):
    """Semantic scan of whole texts, whatever their size."""
    return scan(docs(spark, sf), [FileLengthRule(DOC_LENGTHS), LineRulesRule(CUSTOM_RULES)])


def q_entry_files(spark, sf):
    lines = splitlines(F.col("text"))
    return docs(spark, sf).where(taint.entry_file(F.col("file"), lines, TAINT_ENTRIES)).select("file")


def q_sensitive_lines(spark, sf):
    rx = any_regex(TAINT_SENSITIVE)
    numbered = F.transform(splitlines(F.col("text")), lambda l, i: F.struct((i + 1).alias("line"), l.alias("text")))
    hits = F.filter(numbered, lambda x: x["text"].rlike(rx))
    return docs(spark, sf).select("file", F.explode(hits).alias("x")).select(
        "file", F.col("x.line").cast("bigint").alias("line")
    )


def q_sink_lines(spark, sf):
    numbered = F.transform(splitlines(F.col("text")), lambda l, i: F.struct((i + 1).alias("line"), l.alias("text")))
    hits = F.when(contains_any(F.col("text"), TAINT_SINKS), F.filter(numbered, lambda x: contains_any(x["text"], TAINT_SINKS)))
    return docs(spark, sf).select("file", F.explode(hits).alias("x")).select(
        "file", F.col("x.line").cast("bigint").alias("line")
    )


def q_file_metrics(spark, sf):
    return file_metrics(docs(spark, sf))


def q_complexity_proxy(spark, sf):
    return complexity_proxy(docs(spark, sf))


def q_detect_language(spark, sf):
    return detect_language(pages_corpus(spark, sf).select("file"))


def q_secret_confidence(spark, sf):
    return secret_confidence(docs(spark, sf), CONFIDENCE_HIT, CONFIDENCE_LOW, CONFIDENCE_HIGH)


def q_severity_breakdown(spark, sf):
    return summary.severity_breakdown(q_all_issues(spark, sf))


def all_issues_repo(spark, sf):
    """All issues with the repository (document source) and scoring category attached."""
    return scan(docs(spark, sf), all_issue_rules(), keep=["repo"]).withColumn("category", FU.category(F.col("tool")))


def event_issues(spark, sf):
    ev = table(spark, sf, "events")
    sev = F.lit("INFO")
    for k, v in EVENT_SEVERITY.items():
        sev = F.when(F.col("event_type") == k, F.lit(v)).otherwise(sev)
    return ev.select(
        "event_id", "ts",
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file"),
        F.col("event_type").alias("rule_id"), sev.alias("severity"), F.col("props").alias("message"),
    )


def issues_once(spark, sf):
    """All issues as a table: what several branches of a query read, one scan has written."""
    from corpuscope.sources.scratch import Scratch

    return Scratch(spark, "issues").save(q_all_issues(spark, sf), "issues")


def q_scan_totals(spark, sf):
    return summary.totals_of_scan(scan(docs(spark, sf), all_issue_rules(), every_file=True))


def q_issue_rollup(spark, sf):
    return summary.issue_rollup(q_all_issues(spark, sf))


def q_top_issues(spark, sf):
    order = [F.lower("file"), F.col("file"), F.col("line"), F.coalesce("column", F.lit(0)), F.col("rule_id"),
             F.col("message"), F.coalesce("code_snippet", F.lit(""))]
    t = summary.top_issues(issues_once(spark, sf), TOP_K, order)
    return t.select("severity", "rank_in_severity", "file", "line", "rule_id", "message", "severity_total", "remaining")


def q_repo_summary(spark, sf):
    return summary.repo_summary(all_issues_repo(spark, sf))


def q_quality_gate(spark, sf):
    d = docs(spark, sf)
    text = F.col("text")
    from corpuscope.operators.scan import BOOLEAN_PATTERN, DECISION_PATTERN, DEFINITIONS

    metrics = d.select(
        count_newline_lines(text).alias("n_lines"),
        F.regexp_count(text, F.lit(DEFINITIONS["python"].pattern)).alias("n_functions"),
        (F.lit(1) + F.regexp_count(text, F.lit(DECISION_PATTERN)) + F.regexp_count(text, F.lit(BOOLEAN_PATTERN))).alias("complexity"),
    )
    return summary.quality_gate(all_issues_repo(spark, sf), metrics)


def q_composite_score(spark, sf):
    rows = scan(docs(spark, sf), all_issue_rules(), keep=["repo"], every_file=True)
    return summary.composite_score(None, rows.withColumn("category", FU.category(F.col("tool"))))


def q_severity_level(spark, sf):
    e = event_issues(spark, sf)
    return e.select("event_id", "severity", S.sarif_level(F.col("severity")).alias("level"))


def q_severity_threshold(spark, sf):
    return summary.severity_filter(event_issues(spark, sf), SEVERITY_THRESHOLD).select("event_id", "severity")


def q_dedupe_issues(spark, sf):
    """U-4: all rules, and secret and custom rules once more, in one scan; deduplicated."""
    again = [SecretPatternRule(SECRET_RULES, every=False), LineRulesRule(CUSTOM_RULES)]
    return FU.dedupe(scan(docs(spark, sf), all_issue_rules() + again))


def fuse_input(spark, sf):
    """Two reports from one scan: report 0 = MEDIUM/LOW/INFO, report 1 = CRITICAL/HIGH; the rule id
    is reduced to its family so that both reports conflict on the same lines."""
    i = q_all_issues(spark, sf)
    return i.select(
        "file", "line", "column",
        F.regexp_extract("rule_id", "^([A-Z]+)", 1).alias("rule_id"),
        "severity", "message", "tool", "code_snippet",
        F.when(F.col("severity").isin("CRITICAL", "HIGH"), F.lit(1)).otherwise(F.lit(0)).alias("source_ord"),
    )


def q_fuse_keep_first(spark, sf):
    return FU.fuse(fuse_input(spark, sf), "keep-first")


def q_fuse_overwrite(spark, sf):
    return FU.fuse(fuse_input(spark, sf), "overwrite")


def q_fuse_merge(spark, sf):
    return FU.fuse(fuse_input(spark, sf), "merge-conflicts")


def q_baseline_diff(spark, sf):
    i = FU.with_fingerprint(issues_once(spark, sf))
    before = i.where(F.col("severity") != "HIGH")
    after = i.where(F.col("severity") != "CRITICAL")
    return FU.baseline_diff(before, after)


def q_sarif_results(spark, sf):
    return SR.sarif_results(q_all_issues(spark, sf))


def q_sarif_rules(spark, sf):
    return SR.sarif_rules(q_all_issues(spark, sf), RULES_META)


def q_sarif_roundtrip(spark, sf):
    """SNK-1 then SRC-5: issues -> bounded SARIF logs (JSON text) -> parsed back to results."""
    logs = SR.sarif_logs(q_all_issues(spark, sf), rules_meta=RULES_META, max_results=SARIF_RUN_SIZE)
    return SRC_SARIF.parse_sarif(logs).drop("tool")


def q_issue_report_lines(spark, sf):
    return RP.issue_report_lines(q_all_issues(spark, sf), docs(spark, sf))


def q_relative_path(spark, sf):
    from corpuscope.functions.paths import relative_path

    return pages_corpus(spark, sf).select("file", relative_path(F.col("file"), RELATIVE_ROOT).alias("relative"))


def doc_bytes(spark, sf):
    """Documents as raw files: UTF-8, except Latin-1 repositories (when every character fits)
    and BOM-prefixed repositories."""
    d = docs(spark, sf)
    fits = F.col("text").rlike("^[\\x00-\\xFF]*$")
    content = (
        F.when(F.col("repo").isin(BOM_REPOS), F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(F.col("repo").isin(LATIN1_REPOS) & fits, F.encode("text", "ISO-8859-1"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return d.select("file", content.alias("content"))


def page_bytes(spark, sf):
    return pages_corpus(spark, sf).select("file", F.encode("text", "UTF-8").alias("content"))


def q_encoding_detect(spark, sf):
    from corpuscope.functions.encoding import detect_encoding

    return doc_bytes(spark, sf).select("file", detect_encoding(F.col("content")).alias("d")).select("file", "d.*")


def q_encoding_issues(spark, sf):
    from corpuscope.operators import repair as RE

    return RE.encoding_issues(RE.check_encoding(doc_bytes(spark, sf)))


def q_encoding_summary(spark, sf):
    from corpuscope.operators import repair as RE

    return RE.encoding_summary(RE.check_encoding(doc_bytes(spark, sf)))


def q_encoding_report(spark, sf):
    from corpuscope.operators import repair as RE

    return RE.encoding_report_lines(RE.check_encoding(doc_bytes(spark, sf)))


def q_entities_decoded(spark, sf):
    from corpuscope.functions.repair import decode_entities

    p = pages_corpus(spark, sf).select("file", decode_entities(F.col("text")).alias("e"))
    return p.select("file", F.md5(F.col("e.text")).alias("digest"), F.length("e.text").cast("bigint").alias("n_chars"),
                    F.col("e.error").alias("error"))


def q_links_encoded(spark, sf):
    from corpuscope.functions.repair import HTML_LINK, quote_url

    rx = HTML_LINK
    p = pages_corpus(spark, sf).select("file", F.posexplode(F.regexp_extract_all("text", F.lit(rx), 2)).alias("pos", "href"))
    return p.select("file", (F.col("pos") + 1).cast("bigint").alias("n"), "href", quote_url(F.col("href")).alias("encoded"))


def q_fill_empty(spark, sf):
    from corpuscope.functions.repair import fill_empty
    from corpuscope.sources.tables import conversation_lines

    c = conversation_lines(spark, sf)
    after = fill_empty(F.col("text"))
    return c.select("file", "line", (after != F.col("text")).alias("filled"), F.md5(after).alias("digest"))


def q_repair_dry_run(spark, sf):
    from corpuscope.operators import repair as RE

    r = RE.repair(page_bytes(spark, sf), dry_run=True)
    return r.select("file", "encoding", "confidence", "success", "changed", "message")


def q_duplicate_blocks(spark, sf):
    from corpuscope.operators.duplicates import duplicate_blocks

    return duplicate_blocks(docs(spark, sf), DUP_K)


def q_corpus_paths(spark, sf):
    from corpuscope.sources.files import filter_paths

    return filter_paths(docs(spark, sf).select("file"), PATH_GLOBS).orderBy(F.lower("file"), F.col("file"))


def q_corpus_exclude(spark, sf):
    from corpuscope.sources.files import exclude_paths

    return exclude_paths(docs(spark, sf).select("file"), EXCLUDE_GLOBS)


def q_corpus_suffix(spark, sf):
    from corpuscope.sources.files import suffix_filter

    return suffix_filter(pages_corpus(spark, sf).select("file"), PAGE_SUFFIX)


def q_issue_trend(spark, sf):
    from corpuscope.streaming.trend import issue_trend

    return issue_trend(event_issues(spark, sf), TREND_WINDOW)


def event_feed(spark, sf):
    """Events with the batch in which they arrive."""
    e = event_issues(spark, sf)
    on_time = F.least(F.floor(F.datediff("ts", F.lit("2024-01-01")) / FEED_DAYS), F.lit(FEED_LAST))
    batch = on_time + F.when(F.col("event_id") % FEED_LATE == 0, 1).otherwise(0)
    return e.select("event_id", "ts", "file", "rule_id", "severity", batch.cast("int").alias("batch"))


def q_stream_trend(spark, sf):
    """ST-2: windows that the watermark has closed, late events dropped."""
    from corpuscope.streaming.trend import issue_trend, replay

    out = replay(event_feed(spark, sf), "batch", lambda s: issue_trend(s, TREND_WINDOW, watermark=FEED_WATERMARK), "trend")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "severity", "n_issues")


def q_stream_dedupe(spark, sf):
    """ST-3: the first issue of each file and rule, late ones dropped."""
    from corpuscope.streaming.trend import first_per_key, replay

    def first(stream):
        keyed = stream.withColumn("fingerprint", F.concat_ws(":", "file", "rule_id"))
        return first_per_key(keyed.drop("batch"), "fingerprint", FEED_WATERMARK, tie_col="event_id")

    return replay(event_feed(spark, sf), "batch", first, "dedupe").select("fingerprint", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "severity")


def _document_files(spark, sf, scratch, where=None):
    """``documents`` written as files below a scratch folder; the folder."""
    from corpuscope.sinks.files import write_documents

    rows = docs(spark, sf) if where is None else docs(spark, sf).where(where)
    write_documents(rows.select(F.col("file").alias("name"), F.col("text").alias("content")), scratch.path("tree"))
    return scratch.path("tree")


def _file_rows(files, folder):
    """Name, lines, bytes and digest of files read back."""
    from corpuscope.sources.files import as_text_corpus
    from corpuscope.sources.store import normalise

    name = F.substring_index("file", normalise(folder) + "/", -1)
    return as_text_corpus(files).select(
        name.alias("file"), count_newline_lines(F.col("text")).cast("bigint").alias("n_lines"),
        F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("digest"),
    )


def q_corpus_files(spark, sf):
    """SNK-4, SRC-1: documents written as one file each, listed and read back."""
    from corpuscope.sources.files import read_corpus
    from corpuscope.sources.scratch import Scratch

    st = Scratch(spark, "files")
    folder = _document_files(spark, sf, st)
    out = st.save(_file_rows(read_corpus(spark, f"{folder}/**/*.md"), folder), "rows")
    st.drop("tree")
    return out


def q_corpus_chunks(spark, sf):
    """R-3: the same files read in chunks of lines; lines and bytes summed, the digest of the chunks in order."""
    from corpuscope.sources.files import as_text_corpus, read_chunks
    from corpuscope.sources.scratch import Scratch
    from corpuscope.sources.store import normalise

    st = Scratch(spark, "chunks")
    folder = _document_files(spark, sf, st)
    chunks = read_chunks(spark, f"{folder}/**/*.md", chunk_bytes=CHUNK_BYTES)
    text = chunks.select(F.substring_index("path", normalise(folder) + "/", -1).alias("file"), "chunk", "first_line", F.col("content").cast("string").alias("text"))
    whole = text.groupBy("file").agg(
        F.max(F.col("first_line") - 1 + count_newline_lines(F.col("text"))).cast("bigint").alias("n_lines"), F.sum(F.octet_length("text")).alias("n_bytes"),
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "")).alias("digest"),
    )
    out = st.save(whole, "rows")
    st.drop("tree")
    return out


def q_incremental_files(spark, sf):
    """ST-1: files that arrive in two waves, streamed from the log of seen files; a third look finds nothing new."""
    from corpuscope.sources.files import discover, stream_seen
    from corpuscope.sources.scratch import Scratch
    from corpuscope.streaming.incremental import run_available

    st = Scratch(spark, "waves")
    for wave in (F.col("repo") < WAVE_SPLIT, ~F.coalesce(F.col("repo") < WAVE_SPLIT, F.lit(False)), F.lit(False)):
        folder = _document_files(spark, sf, st, wave)
        discover(spark, f"{folder}/**/*.md", st.path("log"))
        rows = _file_rows(stream_seen(spark, st.path("log")), folder)
        run_available(rows, "waves", sink_path=st.path("rows"), checkpoint=st.path("checkpoint"))
    st.drop("tree")
    return spark.read.schema(rows.schema).parquet(st.path("rows"))


def q_sarif_files(spark, sf):
    """SNK-1: one log a file, read back with whole-file JSON."""
    from corpuscope.sources.scratch import Scratch

    st = Scratch(spark, "sarif")
    manifest = SR.write_sarif(SR.sarif_logs(q_all_issues(spark, sf), rules_meta=RULES_META, max_results=SARIF_RUN_SIZE), st.path("logs"))
    logs = spark.read.option("multiLine", True).schema(SRC_SARIF.SARIF_SCHEMA).json(st.path("logs"))
    flat = st.save(SRC_SARIF.sarif_to_results(logs.select(F.struct("version", "runs").alias("log"))).drop("tool"), "rows")
    assert manifest.count() == logs.count()
    return flat


def q_sarif_import(spark, sf):
    """SRC-5: a log for each document, whose results name their rule by index, their level by the rule's default, their
    message by id, and two locations; read back from files, the larger ones cut while they are read."""
    from corpuscope.sinks.files import write_documents
    from corpuscope.sources.sarif import read_sarif_files
    from corpuscope.sources.scratch import Scratch

    st = Scratch(spark, "import")
    rules = F.from_json(F.lit(json.dumps([
        {"id": r.rule_id, "defaultConfiguration": {"level": level} if level else None, "messageStrings": {"found": {"text": r.message + " (ligne {0})"}}}
        for r, level in zip(CUSTOM_RULES, IMPORT_LEVELS)
    ])), "array<struct<id:string,defaultConfiguration:struct<level:string>,messageStrings:map<string,struct<text:string>>>>")
    number = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(CUSTOM_RULES) for x in (r.rule_id, i)]), F.col("rule_id"))

    def place(line, **file):
        where = F.struct(*[v.alias(k) for k, v in file.items()])
        return F.struct(F.struct(where.alias("artifactLocation"), F.struct(line.cast("int").alias("startLine")).alias("region")).alias("physicalLocation"))

    none, here = F.lit(None).cast("string"), F.lit(0)
    result = F.struct(
        number.alias("ruleIndex"), F.struct(F.lit("found").alias("id"), F.array(F.col("line").cast("string")).alias("arguments")).alias("message"),
        F.array(place(F.col("line"), uri=none, index=here), place(F.col("line") + 1, uri=F.col("file"), index=F.lit(-1))).alias("locations"),
    )
    # the results of a document: as many as it has lines, times the rules
    found = q_custom_rules(spark, sf).groupBy("file").agg(F.sort_array(F.collect_list(result)).alias("results"))
    run = F.struct(
        F.col("results"), F.struct(F.struct(F.lit("rules").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"),
        F.array(F.struct(F.struct(F.col("file").alias("uri")).alias("location"))).alias("artifacts"),
    )
    log = F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs")))
    write_documents(found.select(F.concat("file", F.lit(".sarif")).alias("name"), log.alias("content")), st.path("logs"))
    out = st.save(read_sarif_files(spark, f"{st.path('logs')}/**/*.sarif", split_bytes=IMPORT_SPLIT), "rows")
    st.drop("logs")
    return out


def q_sonar_import(spark, sf):
    """SRC-6: a Sonar document for each file with issues of the custom rules, parsed back to issues."""
    sonar = F.element_at(F.create_map(*[F.lit(x) for kv in SONAR_OF.items() for x in kv]), F.col("severity"))
    one = F.struct(F.col("rule_id").alias("rule"), "message", sonar.alias("severity"), F.col("file").alias("component"), F.col("line").cast("int").alias("line"))
    reports = q_custom_rules(spark, sf).groupBy("file").agg(F.sort_array(F.collect_list(one)).alias("issues"))  # a file's lines times the rules
    text = reports.select(F.to_json(F.struct("issues")).alias("report"))
    return SRC_SARIF.parse_sonar(text, "report").select("file", "line", "rule_id", "severity", "message", "tool")


def q_decoded_bytes(spark, sf):
    """S-2: the byte corpus decoded by its detected encoding."""
    from corpuscope.functions.encoding import decode_bytes, detect_encoding

    d = doc_bytes(spark, sf).select("file", "content", detect_encoding(F.col("content"))["encoding"].alias("encoding"))
    x = d.select("file", "encoding", decode_bytes(F.col("content"), F.col("encoding")).alias("x"))
    return x.select("file", "encoding", F.col("x.fallback").alias("fallback"), F.md5(F.col("x.text")).alias("digest"), F.length("x.text").cast("bigint").alias("n_chars"))


def q_anchors_fixed(spark, sf):
    """S-4: documents with an anchor whose id ends in as many blanks as the document's number tells."""
    from corpuscope.functions.repair import fix_anchor_ids

    d = table(spark, sf, "documents")
    number = F.col("doc_id").cast("string")
    blanks = F.repeat(F.lit(" "), (F.col("doc_id") % 4).cast("int"))
    text = F.concat(F.lit('<a ID = "x '), number, blanks, F.lit('" class="y ">'), F.col("text"))
    return d.select("doc_id", F.md5(fix_anchor_ids(text)).alias("digest"))


def q_settings(spark, sf):
    """F-KV: settings of each document as a map; the first sign splits, later keys win."""
    from corpuscope.functions.settings import settings_map

    d = table(spark, sf, "documents")
    items = F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("path="), "source", F.lit("=x")), F.lit("flag"), F.concat(F.lit("lang=late-"), "lang"))
    m = settings_map(items)
    return d.select("doc_id", m["lang"].alias("lang"), m["path"].alias("path"), F.size(m).cast("bigint").alias("n"))


def q_selected_rules(spark, sf):
    """X-2: rules chosen by name, with settings."""
    from corpuscope.operators.registry import build_rules

    rules = build_rules(["file-length", "line-rules"], {"file-length": {"thresholds": DOC_LENGTHS}, "line-rules": {"rules": CUSTOM_RULES}})
    return scan(docs(spark, sf), rules)


def q_dangerous_calls(spark, sf):
    """X-9: dangerous calls by language; prose becomes code by its joining words, and its language one of programs."""
    from corpuscope.operators.rule_table import scan_rule_table
    from corpuscope.operators.scan import dangerous_call_table

    text = F.col("text")
    for old, new in CODE_OF.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in PROGRAM_OF.items() for x in kv]), F.col("lang"))
    code = docs(spark, sf).select("file", text.alias("text"), lang.alias("lang"))
    return scan_rule_table(code, dangerous_call_table(spark))


def q_secret_scores(spark, sf):
    """X-7: confidence of every secret by context, entropy and position."""
    from corpuscope.operators.secrets import secret_scores

    return secret_scores(docs(spark, sf), SECRET_RULES)


def q_metrics_csv(spark, sf):
    """SNK-5: file metrics written as CSV and read back."""
    from corpuscope.sources.scratch import Scratch

    st = Scratch(spark, "csv")
    metrics = q_file_metrics(spark, sf)
    RP.write_csv(metrics, st.path("metrics"))
    return spark.read.schema(metrics.schema).option("header", True).csv(st.path("metrics"))


def q_issues_json(spark, sf):
    """SNK-6: issues written as JSON, a folder for each repository, and read back."""
    from corpuscope.sources.scratch import Scratch

    st = Scratch(spark, "json")
    issues = scan(docs(spark, sf), all_issue_rules(), keep=["repo"]).select("repo", "file", "line", "rule_id", "severity", "message")
    RP.write_json(issues, st.path("issues"), partition_by=["repo"])
    return spark.read.schema(issues.schema).json(st.path("issues"))


def _doc_files(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))


def q_quality_files(spark, sf):
    """J-4: documents whose label says quality = 1 (semi join; the key table's size is checked
    before it may be broadcast)."""
    from corpuscope.operators.joins import semi_join

    good = table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    return semi_join(_doc_files(spark, sf), good, "doc_id").select("file")


def q_exclude_listed(spark, sf):
    """J-5: documents minus those listed as toxic in ``labels`` (anti join)."""
    from corpuscope.operators.joins import anti_join

    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    return anti_join(_doc_files(spark, sf), toxic, "doc_id").select("file")


def q_secret_scan(spark, sf):
    """Secret scan as the command runs it: exclude globs, then patterns and entropy in one pass."""
    from corpuscope.operators.secrets import scan_secrets
    from corpuscope.sources.globs import globs_to_regex

    return scan_secrets(docs(spark, sf), ENTROPY_THRESHOLD, globs_to_regex(SECRET_EXCLUDE, True), SECRET_RULES, every=False)


def q_secret_matches(spark, sf):
    """R-5, R-7: every secret and every hot token of a line, each at its place, all masked."""
    from corpuscope.operators.secrets import scan_secrets

    return scan_secrets(docs(spark, sf), ENTROPY_THRESHOLD, patterns=SECRET_RULES)


def q_taint_report_markdown(spark, sf):
    """SNK-2 Markdown variant of the taint report, listing patterns, entry points and sinks."""
    extra = {"Patterns sensibles": ", ".join(TAINT_SENSITIVE), "Entry points": ", ".join(TAINT_ENTRIES),
             "Sinks": ", ".join(TAINT_SINKS)}
    return RP.issue_report_markdown(q_taint_flow(spark, sf), docs(spark, sf),
                                    title="Rapport d'Analyse de Taint (Flux de Données) - corpuscope", extra=extra)


def q_encoding_issues_strict(spark, sf):
    from corpuscope.operators import repair as RE

    return RE.encoding_issues(RE.check_encoding(doc_bytes(spark, sf), STRICT_ACCEPT, STRICT_MIN_CONFIDENCE))


def q_encoding_report_markdown(spark, sf):
    from corpuscope.operators import repair as RE

    return RE.encoding_report_markdown(RE.check_encoding(doc_bytes(spark, sf)))


def q_top_issues_summary(spark, sf):
    """W-3 console summary of all issues (first 10 per severity, then the remainder count)."""
    return RP.top_issues_lines(issues_once(spark, sf), TOP_K)


def q_taint_flow_lines(spark, sf):
    """Taint on the line table Spark derives from documents (one row per splitlines() line)."""
    numbered = F.transform(splitlines(F.col("text")), lambda l, i: F.struct((i + 1).alias("line"), l.alias("text")))
    lines = docs(spark, sf).select("file", F.explode(numbered).alias("x")).select("file", "x.line", "x.text")
    return taint.taint_lines(lines, TAINT_SENSITIVE, TAINT_ENTRIES, TAINT_SINKS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "line_counts": q_line_counts,
    "splitlines_count": q_splitlines_count,
    "taint_flow": q_taint_flow,
    "taint_flow_window": q_taint_flow_window,
    "long_files": q_long_files,
    "many_definitions": q_many_definitions,
    "parse_errors": q_parse_errors,
    "secret_patterns": q_secret_patterns,
    "secret_entropy": q_secret_entropy,
    "custom_rules": q_custom_rules,
    "all_issues": q_all_issues,
    "semantic_scan": q_semantic_scan,
    "entry_files": q_entry_files,
    "sensitive_lines": q_sensitive_lines,
    "sink_lines": q_sink_lines,
    "file_metrics": q_file_metrics,
    "complexity_proxy": q_complexity_proxy,
    "detect_language": q_detect_language,
    "secret_confidence": q_secret_confidence,
    "severity_breakdown": q_severity_breakdown,
    "scan_totals": q_scan_totals,
    "issue_rollup": q_issue_rollup,
    "top_issues": q_top_issues,
    "repo_summary": q_repo_summary,
    "quality_gate": q_quality_gate,
    "composite_score": q_composite_score,
    "severity_level": q_severity_level,
    "severity_threshold": q_severity_threshold,
    "dedupe_issues": q_dedupe_issues,
    "fuse_keep_first": q_fuse_keep_first,
    "fuse_overwrite": q_fuse_overwrite,
    "fuse_merge": q_fuse_merge,
    "baseline_diff": q_baseline_diff,
    "sarif_results": q_sarif_results,
    "sarif_rules": q_sarif_rules,
    "sarif_roundtrip": q_sarif_roundtrip,
    "issue_report_lines": q_issue_report_lines,
    "relative_path": q_relative_path,
    "encoding_detect": q_encoding_detect,
    "encoding_issues": q_encoding_issues,
    "encoding_summary": q_encoding_summary,
    "encoding_report": q_encoding_report,
    "entities_decoded": q_entities_decoded,
    "links_encoded": q_links_encoded,
    "fill_empty": q_fill_empty,
    "repair_dry_run": q_repair_dry_run,
    "duplicate_blocks": q_duplicate_blocks,
    "corpus_paths": q_corpus_paths,
    "corpus_exclude": q_corpus_exclude,
    "corpus_suffix": q_corpus_suffix,
    "issue_trend": q_issue_trend,
    "quality_files": q_quality_files,
    "exclude_listed": q_exclude_listed,
    "secret_scan": q_secret_scan,
    "taint_report_markdown": q_taint_report_markdown,
    "encoding_issues_strict": q_encoding_issues_strict,
    "encoding_report_markdown": q_encoding_report_markdown,
    "top_issues_summary": q_top_issues_summary,
    "taint_flow_lines": q_taint_flow_lines,
    "secret_matches": q_secret_matches,
    "rule_table": q_rule_table,
    "corpus_files": q_corpus_files,
    "corpus_chunks": q_corpus_chunks,
    "incremental_files": q_incremental_files,
    "sarif_files": q_sarif_files,
    "sarif_import": q_sarif_import,
    "sonar_import": q_sonar_import,
    "decoded_bytes": q_decoded_bytes,
    "anchors_fixed": q_anchors_fixed,
    "settings": q_settings,
    "selected_rules": q_selected_rules,
    "dangerous_calls": q_dangerous_calls,
    "secret_scores": q_secret_scores,
    "metrics_csv": q_metrics_csv,
    "issues_json": q_issues_json,
    "stream_trend": q_stream_trend,
    "stream_dedupe": q_stream_dedupe,
}
