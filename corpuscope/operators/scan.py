"""One-pass multi-rule scan (X-1 analyzer interface, X-2 rule selection, U-1 union of results).

A ``Rule`` turns the columns of one file row into ``ARRAY<issue struct>``. ``scan`` splits every
file once, evaluates all selected rules in a single projection and explodes the concatenated
arrays: the corpus is read once whatever the number of rules, and no rule shuffles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope import schema as S
from corpuscope.functions.entropy import shannon_entropy
from corpuscope.functions.lexical import blank_literals
from corpuscope.functions.lines import count_newline_lines, split_newline, splitlines, strip
from corpuscope.functions.literals import text_gate
from corpuscope.functions.text import any_regex, base_name, contains_any

ISSUE_STRUCT = T.StructType([f for f in S.ISSUE_SCHEMA.fields if f.name not in ("file", "fingerprint")])


def empty() -> Column:
    return F.array().cast(T.ArrayType(ISSUE_STRUCT))


def issue(rule_id, severity, message, tool, line=None, column=None, snippet=None) -> Column:
    """Issue struct with the canonical field types (so arrays of different rules concatenate)."""

    def c(v, t):
        if v is None:
            return F.lit(None).cast(t)
        return (v if isinstance(v, Column) else F.lit(v)).cast(t)

    return F.struct(
        c(line if line is not None else 1, "bigint").alias("line"),
        c(column, "bigint").alias("column"),
        c(rule_id, "string").alias("rule_id"),
        c(severity, "string").alias("severity"),
        c(message, "string").alias("message"),
        c(tool, "string").alias("tool"),
        c(snippet, "string").alias("code_snippet"),
    )


def when_issue(cond: Column, st: Column) -> Column:
    """Zero- or one-element issue array."""
    return F.when(cond, F.array(st)).otherwise(empty())


class Row:
    """Column references available to rules inside ``scan``; records which line arrays the
    rules use so ``scan`` only builds those."""

    def __init__(self):
        self.file = F.col("file")
        self.text = F.col("text")
        self.lang = F.col("lang")
        self.used: set[str] = set()

    @property
    def lines(self) -> Column:  # splitlines()
        self.used.add("__lines")
        return F.col("__lines")

    @property
    def nl_lines(self) -> Column:  # split('\n')
        self.used.add("__nl_lines")
        return F.col("__nl_lines")


class Rule:
    """Analyzer interface: ``name``, ``description``, ``issues(row) -> ARRAY<issue>``."""

    name = "rule"
    description = ""
    needs_lang = False
    by_line = True  # what a line gives depends on that line alone

    def issues(self, row: Row) -> Column:  # pragma: no cover - interface
        raise NotImplementedError

    def gate(self, row: Row) -> Column | None:
        """A cheap test that every text with an issue passes; texts that fail those of all rules are not cut into lines.
        None: there is no such test."""
        return None

    def issues_of_pieces(self, pieces: DataFrame) -> DataFrame:
        """Issues of files that come in pieces ``(file, text, lang, first_line, first_text_line)``, cut at line ends.
        Rules that look at single lines have this from ``scan_pieces``; the others add up what the pieces give."""
        raise NotImplementedError(f"{type(self).__name__} does not read files in pieces")

    def apply(self, corpus: DataFrame, **opts) -> DataFrame:
        return scan(corpus, [self], **opts)

    def config_schema(self) -> dict:
        return {}

    def regexes(self) -> list[tuple[str, str]]:
        """(label, Java regex) pairs this rule compiles; checked by ``scan`` before any job."""
        return []


def _line_indices(lines: Column, pred, start: Column | None = None) -> Column:
    """1-based numbers of the lines (from ``start`` on) satisfying ``pred(line)``.

    Works on an index sequence and reads lines with ``element_at``: no per-line struct is built
    for lines that do not match."""
    n = F.size(lines)
    lo = start if start is not None else F.lit(1)
    idx = F.filter(F.sequence(lo, n), lambda i: pred(F.element_at(lines, i)))
    return F.when((n > 0) & (lo >= 1) & (lo <= n), idx).otherwise(F.array().cast("array<int>"))


# --- R-1 -----------------------------------------------------------------------------------------

# --- fixed values: per-language file-length thresholds (very long, long) ---
LENGTH_THRESHOLDS = {"python": (500, 300), "java": (600, 400), "php": (600, 400)}


def _map_literal(d: Mapping, value) -> Column:
    args = []
    for k, v in d.items():
        args += [F.lit(k), value(v)]
    return F.create_map(*args)


@dataclass
class FileLengthRule(Rule):
    """R-1: N001 (MEDIUM) when lines > hi, else N002 (LOW) when lines > lo, per language."""

    thresholds: Mapping[str, tuple[int, int]] = field(default_factory=lambda: dict(LENGTH_THRESHOLDS))
    lang: str | None = None
    name = "file-length"
    description = "Files that are too long for their language"
    needs_lang = True
    by_line = False

    def issues(self, row):
        return self.of_count(F.lit(self.lang) if self.lang else row.lang, count_newline_lines(row.text))

    def issues_of_pieces(self, pieces):
        whole = pieces.groupBy("file", "lang").agg(F.max(F.col("first_line") - 1 + count_newline_lines(F.col("text"))).cast("int").alias("n"))
        lang = F.lit(self.lang) if self.lang else F.col("lang")
        return whole.select("file", F.explode(self.of_count(lang, F.col("n"))).alias("i")).select("file", "i.*")

    def of_count(self, lang: Column, n: Column) -> Column:
        th = _map_literal(self.thresholds, lambda v: F.struct(F.lit(int(v[0])).alias("hi"), F.lit(int(v[1])).alias("lo")))
        t = F.element_at(th, F.lower(lang))
        return (
            F.when(n > t["hi"], F.array(issue(S.RULE_FILE_TOO_LONG, "MEDIUM", F.format_string(S.MSG_FILE_TOO_LONG, n), S.TOOL_SEMANTIC)))
            .when(n > t["lo"], F.array(issue(S.RULE_FILE_LONG, "LOW", F.format_string(S.MSG_FILE_LONG, n), S.TOOL_SEMANTIC)))
            .otherwise(empty())
        )


# --- R-2 -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class DefinitionSpec:
    pattern: str
    threshold: int
    rule_id: str
    message: str


# Definition regexes approximate the syntax nodes the reference counts (python
# function_definition; java method_declaration; php function_definition + method_declaration), in
# texts whose strings and comments are blanked. Thresholds, rule ids and messages are the
# reference's fixed values.
DEFINITIONS = {
    "python": DefinitionSpec(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+\w+", 20, S.RULE_MANY_FUNCTIONS, S.MSG_MANY_FUNCTIONS),
    "java": DefinitionSpec(
        r"(?m)^[ \t]*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)[ \t]+)*"
        r"(?:<[^>\n]*>[ \t]*)?(?!(?:public|protected|private|static|final|abstract|synchronized|native|default)\b)"
        r"[\w\[\]<>?,.]+[ \t]+(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b)\w+[ \t]*\([^)]*\)"
        r"[ \t]*(?:throws[^{;]*)?\{",
        25,
        S.RULE_MANY_METHODS,
        S.MSG_MANY_METHODS,
    ),
    "php": DefinitionSpec(r"(?i)\bfunction[ \t]+&?[ \t]*\w+[ \t]*\(", 25, S.RULE_MANY_FUNCTIONS, S.MSG_MANY_FUNCS_METHODS),
}
CLASS_PATTERNS = {
    "python": r"(?m)^[ \t]*class[ \t]+\w+",
    "java": r"\bclass[ \t]+\w+",
    "php": r"(?i)\bclass[ \t]+\w+",
}


@dataclass
class DefinitionCountRule(Rule):
    """R-2: N003 (LOW) when the definition count exceeds the language threshold."""

    specs: Mapping[str, DefinitionSpec] = field(default_factory=lambda: dict(DEFINITIONS))
    lang: str | None = None
    name = "definition-count"
    description = "Files with too many functions or methods"
    by_line = False

    def regexes(self):
        return [(f"definitions {lang}", sp.pattern) for lang, sp in self.specs.items()]
    needs_lang = True

    def issues(self, row):
        counts = {name: F.regexp_count(blank_literals(row.text, name), F.lit(sp.pattern)) for name, sp in self.specs.items()}
        return self.of_counts(F.lit(self.lang) if self.lang else row.lang, counts)

    def issues_of_pieces(self, pieces):
        """Counts of the pieces, summed; a string or comment that runs over a piece's end is seen as two."""
        names = {name: f"n{k}" for k, name in enumerate(self.specs)}
        lang = F.lit(self.lang) if self.lang else F.col("lang")
        sums = [
            F.sum(F.when(F.lower(lang) == name, F.regexp_count(blank_literals(F.col("text"), name), F.lit(sp.pattern)))).cast("int").alias(names[name])
            for name, sp in self.specs.items()
        ]
        whole = pieces.groupBy("file", "lang").agg(*sums)
        found = self.of_counts(lang, {name: F.col(c) for name, c in names.items()})
        return whole.select("file", F.explode(found).alias("i")).select("file", "i.*")

    def of_counts(self, lang: Column, counts: Mapping[str, Column]) -> Column:
        out = empty()
        for name, sp in self.specs.items():
            n = counts[name]
            this = when_issue(n > sp.threshold, issue(sp.rule_id, "LOW", F.format_string(sp.message, n), S.TOOL_SEMANTIC))
            out = F.when(F.lower(lang) == name, this).otherwise(out)
        return out


# --- R-3 -----------------------------------------------------------------------------------------


def analysis_error(text: Column, max_bytes: int, error: Column | None = None) -> Column:
    """Why a file cannot be analysed, or null: unreadable (with the reader's ``error``, if there is one), larger than
    ``max_bytes``, or not valid UTF-8."""
    size = F.octet_length(text)
    unread = F.lit("contenu illisible")
    return (
        F.when(text.isNull(), unread if error is None else F.coalesce(error, unread))
        .when(size > max_bytes, F.format_string("fichier trop volumineux (%d octets > %d)", size, F.lit(max_bytes)))
        .when(~F.is_valid_utf8(text), F.lit("encodage invalide"))
    )


def error_issue(reason: Column) -> Column:
    return issue(S.RULE_PARSE_ERROR, "INFO", F.format_string(S.MSG_PARSE_ERROR, reason), S.TOOL_SEMANTIC)


# --- R-4 -----------------------------------------------------------------------------------------


@dataclass
class TaintRule(Rule):
    """R-4: in files with an entry point, each sink line at or after the first sensitive line."""

    sensitive_patterns: Sequence[str]
    entry_points: Sequence[str]
    sinks: Sequence[str]
    name = "taint"
    description = "Sensitive data reaching a sink"
    by_line = False

    def regexes(self):
        return [("taint sensitive patterns", any_regex(self.sensitive_patterns))]

    def __post_init__(self):
        if not self.sensitive_patterns or not self.entry_points or not self.sinks:
            raise ValueError("sensitive_patterns, entry_points and sinks are all required")

    def issues_of_pieces(self, pieces):
        from corpuscope.operators.taint import taint_lines

        numbered = F.transform(splitlines(F.col("text")), lambda l, i: F.struct((F.col("first_text_line") + i).alias("line"), l.alias("text")))
        lines = pieces.select("file", F.explode(numbered).alias("x")).select("file", "x.line", "x.text")
        return taint_lines(lines, self.sensitive_patterns, self.entry_points, self.sinks)

    def gate(self, row):
        # whole-text substring tests are supersets of the per-line ones
        sinks, entries = list(self.sinks), list(self.entry_points)
        out = contains_any(row.text, sinks) & (base_name(row.file).isin(entries) | contains_any(row.text, entries))
        sensitive = text_gate(row.text, [any_regex([p]) for p in self.sensitive_patterns])
        return out if sensitive is None else out & sensitive

    def issues(self, row):
        rx = any_regex(self.sensitive_patterns)
        sinks, entries = list(self.sinks), list(self.entry_points)
        gate = self.gate(row)
        entry = (F.size(row.lines) > 0) & (
            base_name(row.file).isin(entries) | F.exists(row.lines, lambda l: contains_any(l, entries))
        )
        # only texts that can hold a match are searched, line by line
        first = F.when(gate, F.array_position(F.transform(row.lines, lambda l: l.rlike(rx)), True).cast("int")).otherwise(F.lit(0))
        hits = _line_indices(row.lines, lambda l: contains_any(l, sinks), start=first)
        out = F.transform(
            hits, lambda i: issue(S.RULE_TAINT, "CRITICAL", S.MSG_TAINT, S.TOOL_TAINT, line=i,
                                  snippet=strip(F.element_at(row.lines, i)))
        )
        return F.when(gate & entry, F.when(first > 0, out).otherwise(empty())).otherwise(empty())


# --- R-5 / R-7 -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class SecretPattern:
    """Named secret regex; ``group`` is the index of the group holding the secret (Spark does not
    expose named groups, so the index stands in for ``(?P<secret>...)``)."""

    name: str
    regex: str
    group: int = 0

    def __post_init__(self):
        # regexp_extract fails the whole task on a group index the pattern lacks: check up front
        # (patterns that only Java understands are left to Spark)
        try:
            groups = re.compile(self.regex).groups
        except re.error:
            return
        if not 0 <= self.group <= groups:
            raise ValueError(f"secret pattern {self.name!r} has {groups} group(s), group {self.group} requested")

    def located(self) -> tuple[str, int | None, int]:
        """``(regex, prefix group, secret group)``: the same regex with what stands before the secret in a group of its
        own, so that the secret's place in a match is known. No prefix group if the secret's group is nested, comes
        after an alternative at the top, or the regex refers back to groups."""
        if self.group == 0:
            return self.regex, None, 0
        depth = opened = top = 0
        in_class = False
        flags = len(re.match(r"(?:\(\?[a-zA-Z]+\))*", self.regex).group())
        k, at = flags, None
        while k < len(self.regex):
            c = self.regex[k]
            if c == "\\":
                if self.regex[k + 1 : k + 2].isdigit() or self.regex[k + 1 : k + 2] in "Qk":
                    return self.regex, None, self.group
                k += 2
                continue
            if in_class:
                in_class = c != "]" or self.regex[k - 1] == "["
            elif c == "[":
                in_class = True
            elif c == "(":
                if self.regex[k + 1 : k + 2] != "?":
                    opened += 1
                    if opened == self.group and at is None:
                        if depth:
                            return self.regex, None, self.group
                        at, top = k, opened
                elif not re.match(r"\(\?(?::|=|!|<=|<!)", self.regex[k:]):
                    return self.regex, None, self.group  # named groups and inner flags
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == "|" and depth == 0:
                return self.regex, None, self.group
            k += 1
        if at is None:
            return self.regex, None, self.group
        return f"{self.regex[:flags]}({self.regex[flags:at]}){self.regex[at:]}", 1, top + 1


def _bind(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def secret_places(line: Column, pattern: SecretPattern) -> Column:
    """``array<struct<start, length>>`` of the secrets of all matches in a line (1-based, by place of the match)."""
    regex, prefix, group = pattern.located()
    matches = F.regexp_extract_all(line, F.lit(regex), F.lit(0))
    secrets = matches if group == 0 else F.regexp_extract_all(line, F.lit(regex), F.lit(group))
    before = F.regexp_extract_all(line, F.lit(regex), F.lit(prefix)) if prefix else F.transform(matches, lambda m: F.lit(""))
    parts = F.arrays_zip(F.split(line, regex, -1).alias("gap"), matches.alias("m"), secrets.alias("s"), before.alias("b"))
    found = F.filter(parts, lambda x: x["m"].isNotNull())

    def place(x, at):
        # without a prefix group: the secret is taken where it stands last in the match
        last = F.length(x["m"]) - F.length(F.call_function("substring_index", x["m"], x["s"], F.lit(-1))) - F.length(x["s"])
        inner = F.length(x["b"]) if prefix or group == 0 else F.when(x["s"] == "", F.lit(0)).otherwise(last)
        return F.struct((at + F.length(x["gap"]) + inner + 1).cast("int").alias("start"), F.length(x["s"]).alias("length"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))
    return F.aggregate(
        found, start,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"), F.array_append(acc["out"], place(x, acc["at"])).alias("out")
        ),
        lambda acc: acc["out"],
    )


def _masked(line: Column, places: Column) -> Column:
    """The line with each place replaced by three stars, from the last one to the first."""
    last_first = F.reverse(F.array_sort(F.array_distinct(F.filter(places, lambda p: p["length"] > 0))))
    return F.aggregate(
        last_first, line,
        lambda t, p: F.concat(t.substr(F.lit(1), p["start"] - 1), F.lit("***"), t.substr(p["start"] + p["length"], F.lit(1 << 30))),
    )


# --- fixed values: secret keywords of the configuration example ---
DEFAULT_KEYWORDS = ["password", "secret", "api_key", "token", "private_key"]
# Our assignment pattern around each keyword: keyword, optional suffix, = or :, quoted value.
DEFAULT_SECRET_PATTERNS = [
    SecretPattern(k, r"(?i)\b" + k.replace("_", "[_-]?") + r"\w*\s*[:=]\s*['\"]([^'\"\s]+)['\"]", 1)
    for k in DEFAULT_KEYWORDS
]
DEFAULT_ENTROPY_THRESHOLD = 4.5
# Our candidate-token shape for the entropy rule (base64 / hex / url-safe alphabets).
TOKEN_PATTERN = r"[A-Za-z0-9+/=_-]{20,}"


@dataclass
class SecretPatternRule(Rule):
    """R-5: CRITICAL for each match of a pattern in a line (``every=False``: for the first); column = position of the
    secret. The snippet masks the secrets of all patterns at their places, so no issue shows the secret of another."""

    patterns: Sequence[SecretPattern] = field(default_factory=lambda: list(DEFAULT_SECRET_PATTERNS))
    every: bool = True
    name = "secret-patterns"
    description = "Hard-coded secrets matching known patterns"

    def regexes(self):
        return [(f"secret pattern {p.name}", p.regex) for p in self.patterns]

    def issues(self, row):
        pats = list(self.patterns)
        alt = any_regex([p.regex for p in pats], flags="")
        cand = _line_indices(row.lines, lambda l: l.rlike(alt))

        def of_line(i, t):
            found = F.array(*[F.struct(F.lit(p.name).alias("name"), secret_places(t, p).alias("places")) for p in pats])

            def of_found(fs):
                everywhere = F.flatten(F.transform(fs, lambda f: f["places"]))
                return _bind(strip(_masked(t, everywhere)), lambda snippet: F.flatten(F.transform(fs, lambda f: F.transform(
                    f["places"] if self.every else F.slice(f["places"], 1, 1), lambda p: issue(F.concat(F.lit(S.RULE_SECRET_PREFIX), f["name"]), "CRITICAL", F.format_string(S.MSG_SECRET, f["name"]),
                                                 S.TOOL_SECRETS, line=i, column=p["start"], snippet=snippet)))))

            return _bind(found, of_found)

        out = F.flatten(F.transform(cand, lambda i: _bind(F.element_at(row.lines, i), lambda t: of_line(i, t))))
        return _behind(self.gate(row), out)

    def gate(self, row):
        return text_gate(row.text, [p.regex for p in self.patterns])


def _behind(gate: Column | None, found: Column) -> Column:
    """``found`` only for texts that can hold a match (see ``functions.literals``)."""
    return found if gate is None else F.when(gate, found).otherwise(empty())


def _token_start_anchored(tp: str) -> str:
    """``[cls]{n,}`` -> ``(?<![cls])[cls]{n,}``: the same (leftmost, greedy) matches, but the
    engine only starts at token boundaries instead of retrying inside every shorter word."""
    m = re.fullmatch(r"(\[[^\]]+\])\{\d+,\}", tp)
    return f"(?<!{m.group(1)}){tp}" if m else tp


@dataclass
class EntropyRule(Rule):
    """R-7: HIGH for each token whose entropy exceeds the threshold (``every=False``: for the first of a line); the
    snippet masks them all."""

    threshold: float = DEFAULT_ENTROPY_THRESHOLD
    token_pattern: str = TOKEN_PATTERN
    every: bool = True
    name = "secret-entropy"
    description = "High-entropy strings (possible encoded secrets)"

    def regexes(self):
        return [("entropy token pattern", self.token_pattern)]

    def issues(self, row):
        tp = _token_start_anchored(self.token_pattern)
        limit = F.lit(float(self.threshold))
        cand = _line_indices(row.lines, lambda l: l.rlike(tp))

        def of_line(i, t):
            token = SecretPattern("token", tp)
            hot = F.filter(
                F.transform(secret_places(t, token), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"),
                                                                  shannon_entropy(t.substr(p["start"], p["length"])).alias("entropy"))),
                lambda h: h["entropy"] > limit,
            )
            return _bind(hot, lambda hs: F.when(F.size(hs) > 0, _bind(
                strip(_masked(t, F.transform(hs, lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length"))))),
                lambda snippet: F.transform(hs if self.every else F.slice(hs, 1, 1), lambda h: issue(
                    S.RULE_ENTROPY, "HIGH", F.format_string(S.MSG_ENTROPY, h["entropy"]), S.TOOL_SECRETS, line=i, column=h["start"], snippet=snippet)),
            )).otherwise(empty()))

        out = F.flatten(F.transform(cand, lambda i: _bind(F.element_at(row.lines, i), lambda t: of_line(i, t))))
        return _behind(self.gate(row), out)

    def gate(self, row):
        tp = _token_start_anchored(self.token_pattern)
        # look-behind for a token character sees the same in the text as in the line, as no token spans lines
        if tp != self.token_pattern and not re.search(tp, "x\n" * 64):
            return row.text.rlike(tp)
        return text_gate(row.text, [self.token_pattern])


# --- R-6 / F-7 / X-9 -----------------------------------------------------------------------------


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    pattern: str
    severity: str = "MEDIUM"
    message: str = ""
    tool: str = S.TOOL_RULES


# --- fixed values: dangerous calls (roadmap list and configured sinks) ---
DANGEROUS_CALLS = [
    LineRule("DANGER-EVAL", r"\beval\s*\(", "HIGH", "Appel dangereux: eval"),
    LineRule("DANGER-EXEC", r"\bexec\s*\(", "HIGH", "Appel dangereux: exec"),
    LineRule("DANGER-SYSTEM", r"\bsystem\s*\(", "HIGH", "Appel dangereux: system"),
    LineRule("DANGER-SHELL-EXEC", r"\bshell_exec\s*\(", "HIGH", "Appel dangereux: shell_exec"),
    LineRule("DANGER-PASSTHRU", r"\bpassthru\s*\(", "HIGH", "Appel dangereux: passthru"),
    LineRule("DANGER-IMPORT", r"\b__import__\s*\(", "MEDIUM", "Appel dangereux: __import__"),
    LineRule("DANGER-COMPILE", r"\bcompile\s*\(", "LOW", "Appel dangereux: compile"),
    LineRule("DANGER-INNERHTML", r"\.innerHTML\s*=", "MEDIUM", "Affectation dangereuse: innerHTML"),
    LineRule("DANGER-STRCPY", r"\bstrcpy\s*\(", "HIGH", "Appel dangereux: strcpy"),
    LineRule("DANGER-EXTRACT", r"\bextract\s*\(\s*\$_", "HIGH", "Appel dangereux: extract sur entree utilisateur"),
]


# --- fixed values: dangerous calls of one language each (roadmap lists) ---
DANGEROUS_CALLS_OF = {
    "javascript": [("EVAL", r"\beval\s*\("), ("INNERHTML", r"\.innerHTML\s*="), ("DOCUMENT-WRITE", r"\bdocument\.write\s*\(")],
    "c": [("STRCPY", r"\bstrcpy\s*\("), ("GETS", r"\bgets\s*\("), ("MALLOC", r"\bmalloc\s*\("), ("FREE", r"\bfree\s*\(")],
    "go": [("UNSAFE", r"\bunsafe\."), ("REFLECT", r"\breflect\.")],
    "ruby": [("EVAL", r"\beval\b"), ("SEND", r"\.send\b"), ("CONSTANTIZE", r"\.constantize\b")],
    "php": [("EVAL", r"\beval\s*\("), ("EXTRACT", r"\bextract\s*\(\s*\$_"), ("VARIABLE-VARIABLE", r"\$\$\w"), ("SILENCED", r"(?:^|[=(,;\s])@\w+\s*\(")],
    "python": [("EVAL", r"\beval\s*\("), ("EXEC", r"\bexec\s*\("), ("SYSTEM", r"\bos\.system\s*\("), ("IMPORT", r"\b__import__\s*\(")],
}
DANGEROUS_ALIAS = {"typescript": "javascript", "cpp": "c"}


def dangerous_call_table(spark, langs: Sequence[str] | None = None) -> DataFrame:
    """X-9: the dangerous calls of each language as a rule table (``operators.rule_table``)."""
    rows = []
    for lang in langs or [*DANGEROUS_CALLS_OF, *DANGEROUS_ALIAS]:
        for name, pattern in DANGEROUS_CALLS_OF[DANGEROUS_ALIAS.get(lang, lang)]:
            rows.append((f"DANGER-{lang.upper()}-{name}", lang, pattern, "HIGH", f"Appel dangereux ({lang}): {name.lower()}"))
    return spark.createDataFrame(rows, "rule_id string, lang string, pattern string, severity string, message string")


@dataclass
class LineRulesRule(Rule):
    """R-6: every (line, rule) where the rule's regex is found; what the patterns require gates the file, one
    alternation the line, then each literal pattern (compiled once) is tested on candidate lines only. For rule tables
    see ``operators.rule_table``."""

    rules: Sequence[LineRule] = field(default_factory=lambda: list(DANGEROUS_CALLS))
    name = "line-rules"
    description = "User rule table (regex per line)"

    def regexes(self):
        return [(f"rule {r.rule_id}", r.pattern) for r in self.rules]

    def issues(self, row):
        rules = list(self.rules)
        alt = any_regex([r.pattern for r in rules], flags="")
        cand = _line_indices(row.lines, lambda l: l.rlike(alt))

        def per_line(i):
            t = F.element_at(row.lines, i)
            return F.array_compact(
                F.array(*[
                    F.when(t.rlike(r.pattern), issue(r.rule_id, r.severity, r.message or r.rule_id, r.tool,
                                                     line=i, snippet=strip(t)))
                    for r in rules
                ])
            )

        return _behind(self.gate(row), F.flatten(F.transform(cand, per_line)))

    def gate(self, row):
        return text_gate(row.text, [r.pattern for r in self.rules])


# --- the scan ------------------------------------------------------------------------------------


def prepare(corpus: DataFrame, guard: Column | None = None, used=("__lines", "__nl_lines")) -> DataFrame:
    """Add the line arrays the rules use, once (consumers reference the column, Catalyst keeps
    one evaluation). Rows failing ``guard`` (e.g. oversized files) are not split at all."""
    arrays = {"__lines": splitlines(F.col("text")), "__nl_lines": split_newline(F.col("text"))}
    extra = []
    for name in ("__lines", "__nl_lines"):
        if name in used:
            col = arrays[name] if guard is None else F.when(guard, arrays[name])
            extra.append(col.alias(name))
    return corpus.select(*corpus.columns, *extra)


def check_patterns(corpus: DataFrame, rules: Sequence[Rule]) -> None:
    """Compile every rule regex with Java's ``Pattern`` on the driver: a bad user pattern fails
    here with the rule's name, not later inside a task."""
    jvm = corpus.sparkSession.sparkContext._jvm
    for rule in rules:
        for label, pattern in rule.regexes():
            try:
                jvm.java.util.regex.Pattern.compile(pattern)
            except Exception as e:  # py4j error carrying the PatternSyntaxException
                msg = str(e).splitlines()[0] if str(e) else repr(e)
                raise ValueError(f"invalid regex in {label}: {pattern!r} ({msg})") from None


def scan(corpus: DataFrame, rules: Sequence[Rule], max_bytes: int | None = None, keep: Sequence[str] = (), every_file: bool = False) -> DataFrame:
    """Issues of all ``rules`` over ``corpus(file, text[, lang])`` in one pass.

    With ``max_bytes`` a file that cannot be analysed (R-3) yields only its N999 issue; a corpus column ``error`` says why
    it could not be read.
    ``keep`` carries extra corpus columns (e.g. ``repo``) onto every issue row. With ``every_file`` a file without issues
    has a row without a rule, and ``first_of_file`` is true of one row of each file: files and issues are counted from
    one scan.
    """
    if not rules:
        raise ValueError("no rule selected")
    check_patterns(corpus, rules)
    if any(r.needs_lang for r in rules) and "lang" not in corpus.columns and not all(
        getattr(r, "lang", None) for r in rules if r.needs_lang
    ):
        raise ValueError("corpus needs a lang column (or give the rule a fixed lang)")
    extra = [c for c in ("lang", "error") if c in corpus.columns and c not in keep]
    base = corpus.select("file", "text", *extra, *keep)
    row, arrays, gates, used = Row(), [], [], set()
    for r in rules:
        row.used = set()
        arrays.append(r.issues(row))
        if row.used:
            gates.append(r.gate(row))
            used |= row.used
    all_issues = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    guard = None
    if max_bytes is not None:
        err = analysis_error(row.text, max_bytes, F.col("error") if "error" in base.columns else None)
        all_issues = F.when(err.isNotNull(), F.array(error_issue(err))).otherwise(all_issues)
        guard = err.isNull()
    if gates and all(g is not None for g in gates):  # lines only of texts that some rule looks at
        some = gates[0]
        for g in gates[1:]:
            some = some | g
        guard = some if guard is None else guard & some
    prepared = prepare(base, guard, used)
    if every_file:
        rows = prepared.select("file", *keep, F.posexplode_outer(all_issues).alias("pos", "i"))
        return S.issue_frame(rows.select("file", "i.*", *keep, (F.coalesce("pos", F.lit(0)) == 0).alias("first_of_file")))
    out = prepared.select("file", *keep, F.explode(all_issues).alias("i")).select("file", "i.*", *keep)
    return S.issue_frame(out)


def scan_pieces(pieces: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Issues of files that come in pieces ``(file, text, lang, first_line, first_text_line, error)``, cut at line ends;
    lines are numbered as in the whole file. A file that could not be read has its N999 issue, beside the issues of the
    pieces that could."""
    out = []
    by_line = [r for r in rules if r.by_line]
    read = pieces.where("text is not null")
    if by_line:
        found = scan(read, by_line, keep=["first_text_line"])
        out.append(found.withColumn("line", F.col("line") + F.col("first_text_line") - 1).drop("first_text_line"))
    out += [S.issue_frame(r.issues_of_pieces(read)) for r in rules if not r.by_line]
    lost = pieces.where("error is not null").select("file", F.explode(F.array(error_issue(F.col("error")))).alias("i"))
    out.append(S.issue_frame(lost.select("file", "i.*")))
    issues = out[0]
    for o in out[1:]:
        issues = issues.unionByName(o)
    return issues


def parse_errors(corpus: DataFrame, max_bytes: int) -> DataFrame:
    """R-3 alone: one INFO issue per file that cannot be analysed."""
    err = analysis_error(F.col("text"), max_bytes)
    out = corpus.where(err.isNotNull()).select("file", F.explode(F.array(error_issue(err))).alias("i"))
    return S.issue_frame(out.select("file", "i.*"))


def file_metrics(corpus: DataFrame, lang: str = "python") -> DataFrame:
    """A-5: lines, functions and classes per file."""
    text = F.col("text")
    code = blank_literals(text, lang)
    return corpus.select(
        "file",
        count_newline_lines(text).cast("bigint").alias("n_lines"),
        F.regexp_count(code, F.lit(DEFINITIONS[lang].pattern)).cast("bigint").alias("n_functions"),
        F.regexp_count(code, F.lit(CLASS_PATTERNS[lang])).cast("bigint").alias("n_classes"),
    )


def metrics_map(metrics: DataFrame) -> DataFrame:
    """Metrics as ``MAP<STRING,DOUBLE>`` (the per-result metrics dict)."""
    return metrics.select(
        "file",
        F.create_map(
            F.lit("loc"), F.col("n_lines").cast("double"),
            F.lit("functions"), F.col("n_functions").cast("double"),
            F.lit("classes"), F.col("n_classes").cast("double"),
        ).alias("metrics"),
    )


# --- fixed values: decision keywords and boolean operators counted by the complexity proxy ---
DECISION_PATTERN = r"\b(?:if|elif|elseif|for|foreach|while|switch|case|catch)\b"
BOOLEAN_PATTERN = r"&&|\|\||\band\b|\bor\b"


def complexity_proxy(corpus: DataFrame, max_complexity: int = 20) -> DataFrame:
    """X-8: 1 + decision points + boolean operators per file (regex approximation)."""
    text = F.col("text")
    c = (F.lit(1) + F.regexp_count(text, F.lit(DECISION_PATTERN)) + F.regexp_count(text, F.lit(BOOLEAN_PATTERN))).cast("bigint")
    return corpus.select("file", c.alias("complexity"), (c > max_complexity).alias("too_complex"))


# --- fixed values: file extension -> language ---
EXTENSION_LANG = {
    "py": "python", "java": "java", "php": "php", "js": "javascript", "ts": "typescript",
    "md": "markdown", "html": "html", "htm": "html", "c": "c", "h": "c", "cpp": "cpp",
    "cs": "csharp", "go": "go", "rb": "ruby", "rs": "rust",
}


def detect_language(files: DataFrame, path_col: str = "file") -> DataFrame:
    """X-11: language from the extension of the path (query string and fragment ignored)."""
    path = F.regexp_replace(F.col(path_col), r"[?#].*$", "")
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    lang = F.element_at(_map_literal(EXTENSION_LANG, F.lit), ext)
    return files.select(path_col, ext.alias("extension"), F.coalesce(lang, F.lit("unknown")).alias("language"))
