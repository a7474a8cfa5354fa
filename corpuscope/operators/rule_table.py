"""R-6 / F-7 with the rules in a table: ``rule_id, pattern`` and, as far as there are such columns, ``lang, severity,
message, tool``.

Searching every line for every pattern costs lines times rules. Instead each pattern's required literals (every match
contains one of them) index the table. One automaton of all literals reads each text once and gives the lines on which a
literal stands; lines join rules by literal, and only these pairs are searched, with the rule's own regex. Rules that
require no literal that can be told are searched on every line, so no match is lost.

The automaton is broadcast, so literals are dealt into groups of at most ``GROUP_BYTES``; a table with more takes a pass
over the texts for each group. Rules join by hash, broadcast only under the usual size check.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope import schema as S
from corpuscope.functions import literals
from corpuscope.functions.lines import splitlines, strip
from corpuscope.operators.joins import join_lookup
from corpuscope.operators.scan import LineRule, LineRulesRule
from corpuscope.sources.scratch import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP_BYTES = 8 << 20
HITS = "row bigint, file string, lang string, line bigint, text string, literal string, ci boolean"
INDEX = "rule_id string, lang string, pattern string, severity string, message string, tool string, literal string, ci boolean"
_ARROW_INDEX = pa.schema([(n, pa.bool_() if n == "ci" else pa.string()) for n in ("rule_id", "lang", "pattern", "severity", "message", "tool", "literal", "ci")])
_ARROW_HITS = pa.schema([("row", pa.int64()), ("file", pa.string()), ("lang", pa.string()), ("line", pa.int64()), ("text", pa.string()), ("literal", pa.string()), ("ci", pa.bool_())])


def normal_rules(rules: DataFrame) -> DataFrame:
    """The table with all its columns: no language means every language, no message the rule's id."""
    have = set(rules.columns)

    def column(name: str, default):
        col = F.col(name).cast("string") if name in have else F.lit(None).cast("string")
        return (col if default is None else F.coalesce(col, default)).alias(name)

    return rules.select(
        F.col("rule_id").cast("string").alias("rule_id"), F.lower(column("lang", None)).alias("lang"), F.col("pattern").cast("string").alias("pattern"),
        F.upper(column("severity", F.lit("MEDIUM"))).alias("severity"), column("message", F.col("rule_id").cast("string")), column("tool", F.lit(S.TOOL_RULES)),
    ).where("rule_id is not null and pattern is not null").distinct()


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            need = literals.required_literals(r["pattern"])
            base = tuple(r[n] for n in ("rule_id", "lang", "pattern", "severity", "message", "tool"))
            rows += [(*base, lit, need[1]) for lit in sorted(need[0])] if need else [(*base, None, None)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_INDEX)], schema=_ARROW_INDEX)


def rule_index(rules: DataFrame) -> DataFrame:
    """``rules`` by required literal: a row for each literal of a rule, one with a null for rules that require none."""
    return normal_rules(rules).mapInArrow(_index_rows, INDEX)


def literal_groups(index: DataFrame, group_bytes: int = GROUP_BYTES) -> Iterator[list[tuple[str, bool]]]:
    """The distinct literals in groups of bounded size."""
    group, size = [], 0
    for r in index.where("literal is not null").select("literal", "ci").distinct().orderBy("literal", "ci").toLocalIterator():
        group.append((r.literal, r.ci))
        size += len(r.literal) + 16
        if size >= group_bytes:
            yield group
            group, size = [], 0
    if group:
        yield group


def _automaton(entries: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for e in entries:
        out.add_word(e, e)
    out.make_automaton()
    return out


def _value(x):
    return x.as_py()


def _hit_rows(group):
    """Task: lines with the literals that stand on them, each once a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = None
        for b in batches:
            if machines is None:
                machines = [(ci, _automaton(words)) for ci in (False, True) if (words := [w for w, c in group.value if c == ci])]
            for row, file, lang, lines in zip(*(map(_value, b.column(c)) for c in ("row", "file", "lang", "lines"))):  # a text at a time
                rows = []
                for number, line in enumerate(lines or (), 1):
                    for ci, machine in machines:
                        for lit in sorted({lit for _, lit in machine.iter(line.lower() if ci else line)}):
                            rows.append((row, file, lang, number, line, lit, ci))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_HITS)], schema=_ARROW_HITS)

    return run


def scan_rule_table(corpus: DataFrame, rules: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Issues of a rule table over ``corpus(file, text[, lang])``: one for each line and rule whose pattern (Java syntax)
    is found on the line, for rules of the file's language or of none. Rows of the table that are equal count once; null
    texts have no lines; rules without an id or pattern are left out."""
    spark = corpus.sparkSession
    lang = F.lower(F.col("lang")) if "lang" in corpus.columns else F.lit(None).cast("string")
    # tells files of one path apart; literals of one rule may be found in several passes
    files = corpus.select(F.monotonically_increasing_id().alias("row"), "file", lang.alias("lang"), splitlines(F.col("text")).alias("lines"))
    # a pattern that Java cannot read fails here, with the pattern, before any text is searched
    normal_rules(rules).where("'' rlike pattern").count()
    index = Scratch(spark, "rules").save(rule_index(rules), "index")
    out = None
    for group in literal_groups(index, group_bytes):
        hits = files.mapInArrow(_hit_rows(spark.sparkContext.broadcast(group)), HITS).withColumnRenamed("lang", "file_lang")
        pairs = join_lookup(hits, index.where("literal is not null"), ["literal", "ci"], "inner")
        found = pairs.where("(lang is null or lang = file_lang) and text rlike pattern")
        out = found if out is None else out.unionByName(found)
    issues = None
    if out is not None:
        # a line may hold several literals of a rule
        once = out.dropDuplicates(["row", "line", "rule_id", "pattern", "severity", "message", "tool"])
        issues = S.issue_frame(once.select("file", "line", "rule_id", "severity", "message", "tool", strip(F.col("text")).alias("code_snippet")))
    plain = [r for r in index.where("literal is null").toLocalIterator()]
    for name in sorted({r.lang or "" for r in plain}):
        table = [LineRule(r.rule_id, r.pattern, r.severity, r.message, r.tool) for r in plain if (r.lang or "") == name]
        some = corpus if not name else corpus.where(lang == name)
        found = LineRulesRule(table).apply(some.select("file", "text"))
        issues = found if issues is None else issues.unionByName(found)
    return issues if issues is not None else S.issue_frame(corpus.where("false").select("file", F.lit("").alias("rule_id"), F.lit("").alias("severity"),
                                                                                         F.lit("").alias("message"), F.lit("").alias("tool")))
