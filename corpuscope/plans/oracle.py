"""DuckDB SQL equivalents of the registered queries (same column names, same types).

DuckDB regexes are RE2: ``\\s``/``\\w``/``\\d`` are ASCII, ``(?i)`` folds Unicode; character
classes below spell out what the Spark side matches. Lists are 1-based.
"""

from __future__ import annotations

from corpuscope import schema as S
from corpuscope.operators import scan as SC
from corpuscope.operators import secrets as SEC
from corpuscope.operators import summary as SM
from corpuscope.plans import catalog as C
from corpuscope.sinks import reports as RP

# --- fragments ---------------------------------------------------------------------------------

DOCS = (
    "(SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file, text, lang, source AS repo "
    "FROM documents)"
)
PAGES = "(SELECT url AS file, html AS text FROM pages)"

SPLITLINES_RX = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# Python str.strip() whitespace, spelled out for RE2.
WS_CLASS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def splitlines(t: str) -> str:
    parts = f"regexp_split_to_array({t}, '{SPLITLINES_RX}')"
    return (
        f"(CASE WHEN {t} = '' THEN CAST([] AS VARCHAR[]) "
        f"WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"
    )


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_regex(patterns) -> str:
    return sql_str("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def any_regex_cs(patterns) -> str:
    return sql_str("|".join(f"(?:{p})" for p in patterns))


def contains_any(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {sql_str(n)})" for n in needles) + ")"


def base_name(col: str) -> str:
    return f"regexp_extract({col}, '([^/]*)$', 1)"


ISSUE_TAIL = "CAST(NULL AS VARCHAR) AS fingerprint"


def issue_sel(file="file", line="1", column="NULL", rule_id="NULL", severity="NULL", message="NULL",
              tool="NULL", snippet="NULL") -> str:
    return (
        f"SELECT {file} AS file, CAST({line} AS BIGINT) AS line, CAST({column} AS BIGINT) AS \"column\", "
        f"CAST({rule_id} AS VARCHAR) AS rule_id, CAST({severity} AS VARCHAR) AS severity, "
        f"CAST({message} AS VARCHAR) AS message, CAST({tool} AS VARCHAR) AS tool, "
        f"CAST({snippet} AS VARCHAR) AS code_snippet, {ISSUE_TAIL}"
    )


def lines_of(src: str = DOCS) -> str:
    """(file, line, text) of every splitlines() line, 1-based."""
    return (
        f"(SELECT file, unnest(ls) AS text, unnest(generate_series(1, len(ls))) AS line "
        f"FROM (SELECT file, {splitlines('text')} AS ls FROM {src}))"
    )


def values(rows, names) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return sql_str(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"


def taint_sql(sensitive, entries, sinks) -> str:
    ent_in = ", ".join(sql_str(e) for e in entries)
    return f"""
WITH s AS (SELECT file, {splitlines('text')} AS lines FROM {DOCS}),
g AS (
  SELECT file, lines FROM s
  WHERE len(lines) > 0
    AND ({base_name('file')} IN ({ent_in})
         OR len(list_filter(lines, lambda l: {contains_any('l', entries)})) > 0)
),
x AS (SELECT file, unnest(lines) AS text, unnest(generate_series(1, len(lines))) AS line FROM g),
f AS (
  SELECT file, line, text,
         max(CASE WHEN regexp_matches(text, {any_regex(sensitive)}) THEN 1 ELSE 0 END)
           OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latch
  FROM x
)
{issue_sel(line='line', rule_id=sql_str(S.RULE_TAINT), severity="'CRITICAL'", message=sql_str(S.MSG_TAINT),
           tool=sql_str(S.TOOL_TAINT), snippet=strip('text'))}
FROM f WHERE latch = 1 AND {contains_any('text', sinks)}
"""


def length_sql(thresholds, src=DOCS) -> str:
    t = values([(k, v[0], v[1]) for k, v in thresholds.items()], ["lang", "hi", "lo"])
    too = "d.n > t.hi"
    return f"""
SELECT * FROM (
{issue_sel(
    rule_id=f"CASE WHEN {too} THEN {sql_str(S.RULE_FILE_TOO_LONG)} ELSE {sql_str(S.RULE_FILE_LONG)} END",
    severity=f"CASE WHEN {too} THEN 'MEDIUM' ELSE 'LOW' END",
    message=f"CASE WHEN {too} THEN printf({sql_str(S.MSG_FILE_TOO_LONG)}, d.n) ELSE printf({sql_str(S.MSG_FILE_LONG)}, d.n) END",
    tool=sql_str(S.TOOL_SEMANTIC))}
FROM (SELECT file, lang, len(string_split(text, chr(10))) AS n FROM {src}) d
JOIN {t} t ON lower(d.lang) = t.lang
WHERE d.n > t.hi OR d.n > t.lo)
"""


def definitions_sql(specs, lang, src=PAGES) -> str:
    sp = specs[lang]
    n = f"len(regexp_extract_all(text, {sql_str(sp.pattern)}))"
    return f"""
{issue_sel(rule_id=sql_str(sp.rule_id), severity="'LOW'", message=f"printf({sql_str(sp.message)}, {n})",
           tool=sql_str(S.TOOL_SEMANTIC))}
FROM {src} WHERE {n} > {sp.threshold}
"""


def parse_error_reason(max_bytes) -> str:
    return (
        f"(CASE WHEN text IS NULL THEN 'contenu illisible' "
        f"WHEN strlen(text) > {max_bytes} THEN printf('fichier trop volumineux (%d octets > %d)', strlen(text), {max_bytes}) END)"
    )


def parse_errors_sql(max_bytes, src=DOCS) -> str:
    r = parse_error_reason(max_bytes)
    return f"""
{issue_sel(rule_id=sql_str(S.RULE_PARSE_ERROR), severity="'INFO'", message=f"printf({sql_str(S.MSG_PARSE_ERROR)}, {r})",
           tool=sql_str(S.TOOL_SEMANTIC))}
FROM {src} WHERE {r} IS NOT NULL
"""


def secret_sql(patterns, src=DOCS) -> str:
    parts = []
    for p in patterns:
        secret = f"regexp_extract(text, {sql_str(p.regex)}, {p.group})"
        parts.append(
            issue_sel(line="line", column=f"strpos(text, {secret})", rule_id=sql_str(S.RULE_SECRET_PREFIX + p.name),
                      severity="'CRITICAL'", message=sql_str(S.MSG_SECRET % p.name), tool=sql_str(S.TOOL_SECRETS),
                      snippet=strip(f"replace(text, {secret}, '***')"))
            + f" FROM {lines_of(src)} WHERE regexp_matches(text, {sql_str(p.regex)})"
        )
    return "\nUNION ALL\n".join(parts)


def entropy(t: str) -> str:
    chars = f"string_split({t}, '')"
    cnt = f"len(list_filter({chars}, lambda x: x = ch))"
    p = f"({cnt} / len({chars}))"
    return f"(CASE WHEN {t} IS NULL OR {t} = '' THEN 0.0 ELSE abs(list_sum(list_transform(list_distinct({chars}), lambda ch: -{p} * log2({p})))) END)"


def entropy_sql(threshold, token_pattern, src=DOCS) -> str:
    hot = f"list_filter(regexp_extract_all(text, {sql_str(token_pattern)}), lambda tk: {entropy('tk')} > {float(threshold)})"
    return f"""
{issue_sel(line="line", column="strpos(text, hot[1])", rule_id=sql_str(S.RULE_ENTROPY), severity="'HIGH'",
           message=f"printf('Chaîne à haute entropie détectée (entropie %.2f)', {entropy('hot[1]')})", tool=sql_str(S.TOOL_SECRETS),
           snippet=strip("list_reduce(list_prepend(text, hot), lambda a, b: replace(a, b, '***'))"))}
FROM (SELECT file, line, text, {hot} AS hot FROM {lines_of(src)} WHERE regexp_matches(text, {sql_str(token_pattern)}))
WHERE len(hot) > 0
"""


def secret_matches_sql() -> str:
    """Every ``token = "..."`` and every hot token of a line. A match's end is what stands before the gap after it; the
    secret ends one quote before."""
    rx, tk = r'token\s*=\s*"[A-Za-z0-9_]+"', r"[A-Za-z0-9+/=_-]{20,}"

    def places(pattern: str) -> str:
        return (f"(SELECT file, line, text, ms, k, ms[k] AS m, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + "
                f"coalesce(list_sum(list_transform(ms[1:k - 1], lambda g: length(g))), 0) AS before FROM (SELECT file, line, text, "
                f"regexp_extract_all(text, {sql_str(pattern)}) AS ms, regexp_split_to_array(text, {sql_str(pattern)}) AS gaps, "
                f"unnest(generate_series(1, len(regexp_extract_all(text, {sql_str(pattern)})))) AS k FROM {lines_of(DOCS)}))")

    masked = r"""regexp_replace(text, '(token\s*=\s*")[A-Za-z0-9_]+"', '\1***"', 'g')"""
    secrets = (issue_sel(line="line", column="before + strpos(m, '\"') + 1", rule_id="'SEC001-token'", severity="'CRITICAL'",
                         message=sql_str(S.MSG_SECRET % "token"), tool=sql_str(S.TOOL_SECRETS), snippet=strip(masked)) + f" FROM {places(rx)}")
    hot = f"list_filter(ms, lambda tk: {entropy('tk')} > {float(C.ENTROPY_THRESHOLD)})"
    tokens = (issue_sel(line="line", column="before + 1", rule_id=sql_str(S.RULE_ENTROPY), severity="'HIGH'",
                        message=f"printf('Chaîne à haute entropie détectée (entropie %.2f)', {entropy('m')})", tool=sql_str(S.TOOL_SECRETS),
                        snippet=strip(f"list_reduce(list_prepend(text, {hot}), lambda a, b: replace(a, b, '***'))"))
              + f" FROM {places(tk)} WHERE {entropy('m')} > {float(C.ENTROPY_THRESHOLD)}")
    return f"{secrets}\nUNION ALL\n{tokens}"


def line_rules_sql(rules, src=DOCS) -> str:
    parts = []
    for r in rules:
        parts.append(
            issue_sel(line="line", rule_id=sql_str(r.rule_id), severity=sql_str(r.severity),
                      message=sql_str(r.message or r.rule_id), tool=sql_str(r.tool), snippet=strip("text"))
            + f" FROM {lines_of(src)} WHERE regexp_matches(text, {sql_str(r.pattern)})"
        )
    return "\nUNION ALL\n".join(parts)


def sarif_import_sql() -> str:
    parts = []
    for r, level in zip(C.CUSTOM_RULES, C.IMPORT_LEVELS):
        for later in (0, 1):
            parts.append(
                f"SELECT 'rules' AS tool, {sql_str(r.rule_id)} AS rule_id, {sql_str(level or 'warning')} AS level, "
                f"{sql_str(r.message)} || ' (ligne ' || CAST(line AS VARCHAR) || ')' AS message, file AS uri, CAST(line + {later} AS BIGINT) AS start_line, "
                f"CAST(NULL AS BIGINT) AS start_column FROM {lines_of(DOCS)} WHERE regexp_matches(text, {sql_str(r.pattern)})"
            )
    return "\nUNION ALL\n".join(parts)


def dangerous_sql() -> str:
    """Which calls the joining words stand for, by language: only those of the file's own language count."""
    text = "text"
    for old, new in C.CODE_OF.items():
        text = f"replace({text}, {sql_str(old)}, {sql_str(new)})"
    src = f"(SELECT file, lang, {text} AS text FROM {DOCS})"
    own = [("en", "python", "EVAL", "eval("), ("fr", "cpp", "STRCPY", "strcpy("), ("de", "go", "REFLECT", "reflect."), ("es", "ruby", "EVAL", "eval(")]
    return "\nUNION ALL\n".join(
        issue_sel(line="line", rule_id=sql_str(f"DANGER-{program.upper()}-{name}"), severity="'HIGH'", message=sql_str(f"Appel dangereux ({program}): {name.lower()}"),
                  tool=sql_str(S.TOOL_RULES), snippet=strip("text"))
        + f" FROM {lines_of(f'(SELECT * FROM {src} WHERE lang = {sql_str(lang)})')} WHERE contains(text, {sql_str(' ' + call)})"
        for lang, program, name, call in own
    )


def secret_scores_sql() -> str:
    value, rx = "regexp_extract(m, '\"([A-Za-z0-9_]+)\"', 1)", r'token\s*=\s*"[A-Za-z0-9_]+"'
    return f"""SELECT file, line, CAST(before + strpos(m, '"') + 1 AS BIGINT) AS "column", 'token' AS rule, entropy, confidence,
        CASE WHEN confidence < 30 THEN 'probable_false_positive' WHEN confidence < 70 THEN 'to_verify' ELSE 'likely' END AS band FROM (
        SELECT file, line, m, before, entropy, CAST(greatest(0, least(100, 30 + CAST(round(least(entropy, 4.0) * 10) AS INTEGER)
          + CASE WHEN length(v) >= 20 THEN 10 ELSE 0 END - CASE WHEN regexp_matches(text, '^\\s*(#|//|/\\*|\\*|<!--|--)') THEN 20 ELSE 0 END)) AS BIGINT) AS confidence
        FROM (SELECT *, {value} AS v, round({entropy(value)}, 6) AS entropy FROM (SELECT file, line, text, ms[k] AS m,
          list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda g: length(g))), 0) AS before
          FROM (SELECT file, line, text, regexp_extract_all(text, {sql_str(rx)}) AS ms, regexp_split_to_array(text, {sql_str(rx)}) AS gaps,
            unnest(generate_series(1, len(regexp_extract_all(text, {sql_str(rx)})))) AS k FROM {lines_of(DOCS)}))))"""


def rule_table_sql() -> str:
    def of_lang(lang):
        return DOCS if lang is None else f"(SELECT * FROM {DOCS} WHERE lower(lang) = {sql_str(lang.lower())})"

    own = [f"({line_rules_sql([r], of_lang(lang))})" for r, lang in zip(C.CUSTOM_RULES, C.TABLE_LANGS)]
    heads = "(SELECT item_id, regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+ [A-Za-z]+ [A-Za-z]+)', 1) AS head FROM benchmark)"
    items = issue_sel(line="line", rule_id="'ITEM-' || CAST(item_id AS VARCHAR)", severity="'HIGH'", message="'Passage de test'", tool=sql_str(S.TOOL_RULES),
                      snippet=strip("text")) + f" FROM {lines_of(DOCS)} l JOIN {heads} h ON h.head <> '' AND contains(l.text, h.head)"
    return "\nUNION ALL\n".join([*own, f"({items})"])


def all_issues_sql() -> str:
    return "\nUNION ALL\n".join(
        f"({q})"
        for q in (
            length_sql(C.DOC_LENGTHS),
            secret_sql(C.SECRET_RULES),
            entropy_sql(C.ENTROPY_THRESHOLD, SC.TOKEN_PATTERN),
            taint_sql(C.TAINT_SENSITIVE, C.TAINT_ENTRIES, C.TAINT_SINKS),
            line_rules_sql(C.CUSTOM_RULES),
        )
    )


SMALL_DOCS = f"(SELECT * FROM {DOCS} WHERE strlen(text) <= {C.MAX_BYTES})"


def severity_dim_sql() -> str:
    return values(S.SEVERITIES, ["severity", "severity_rank", "level"])


ALL = f"({all_issues_sql()})"


def lines_where(cond: str) -> str:
    return f"SELECT file, CAST(line AS BIGINT) AS line FROM {lines_of()} WHERE {cond}"


EXT_CASE = "CASE ext " + " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in SC.EXTENSION_LANG.items()) + " ELSE 'unknown' END"



CATEGORY = (f"CASE tool WHEN {sql_str(S.TOOL_SECRETS)} THEN 'secrets' WHEN {sql_str(S.TOOL_SEMANTIC)} THEN 'semantic' "
            f"WHEN {sql_str(S.TOOL_TAINT)} THEN 'taint' ELSE 'codeql' END")
ALL_REPO = f"(SELECT *, regexp_extract(file, '^([^/]+)/', 1) AS repo, {CATEGORY} AS category FROM {ALL})"
LEVEL = "CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH') THEN 'error' WHEN upper(severity) = 'MEDIUM' THEN 'warning' ELSE 'note' END"
RANK = "CASE upper(severity) " + " ".join(f"WHEN '{n}' THEN {r}" for n, r, _ in S.SEVERITIES) + f" ELSE {len(S.SEVERITIES)} END"
REPORT_ORDER = "lower(file), file, coalesce(line, 0), coalesce(\"column\", 0), rule_id, message"


def fingerprint_sql() -> str:
    parts = ", ".join(f"coalesce(CAST({'\"column\"' if c == 'column' else c} AS VARCHAR), '')" for c in ("file", "line", "column", "rule_id", "severity", "message"))
    return f"sha256(concat_ws(chr(31), {parts}))"


def quality_gate_sql() -> str:
    metric_expr = {
        "max_file_lines": "len(string_split(text, chr(10)))",
        "max_functions": f"len(regexp_extract_all(text, {sql_str(SC.DEFINITIONS['python'].pattern)}))",
        "max_complexity": f"1 + len(regexp_extract_all(text, {sql_str(SC.DECISION_PATTERN)})) + len(regexp_extract_all(text, {sql_str(SC.BOOLEAN_PATTERN)}))",
    }
    parts = []
    for cat, conf in SM.QUALITY_GATES.items():
        for check, limit in conf.items():
            if check in SM.COUNT_CHECKS:
                cond = f"category = '{cat}'"
                if SM.COUNT_CHECKS[check]:
                    cond += f" AND upper(severity) = '{SM.COUNT_CHECKS[check]}'"
                v = f"(SELECT count(*) FROM {ALL_REPO} WHERE {cond})"
            else:
                v = f"(SELECT coalesce(max({metric_expr[check]}), 0) FROM {DOCS})"
            parts.append(f"SELECT '{cat}' AS category, '{check}' AS \"check\", CAST({v} AS BIGINT) AS value, CAST({limit} AS BIGINT) AS \"limit\"")
    return "SELECT *, value <= \"limit\" AS passed FROM (" + " UNION ALL ".join(parts) + ")"


def composite_sql() -> str:
    pen = "CASE upper(severity) " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in SM.SEVERITY_PENALTY.items()) + " ELSE 0.0 END"
    pens = ", ".join(f"sum(CASE WHEN category = '{c}' THEN {pen} ELSE 0.0 END) AS pen_{c}" for c in SM.SCORE_WEIGHTS)
    score = "0.0"
    for c, w in SM.SCORE_WEIGHTS.items():
        score = f"({score} + {float(w)} * greatest(0.0, 100.0 - coalesce(p.pen_{c}, 0.0) / f.n_files))"
    return f"""SELECT f.repo, f.n_files, round({score}, 4) AS score, round({score}, 4) >= {float(SM.PASSING_SCORE)} AS passed
FROM (SELECT source AS repo, CAST(count(*) AS BIGINT) AS n_files FROM documents GROUP BY source) f
LEFT JOIN (SELECT repo, {pens} FROM {ALL_REPO} GROUP BY repo) p ON f.repo = p.repo"""


EVENT_SEV = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.EVENT_SEVERITY.items()) + " ELSE 'INFO' END"
EVENTS = f"(SELECT event_id, ts, 'user/' || CAST(user_id AS VARCHAR) AS file, event_type AS rule_id, {EVENT_SEV} AS severity, props AS message FROM events)"
FUSE_IN = (f"(SELECT file, line, \"column\", regexp_extract(rule_id, '^([A-Z]+)', 1) AS rule_id, severity, message, tool, "
           f"code_snippet, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 1 ELSE 0 END AS source_ord FROM {ALL})")


def fuse_pick_sql(fn: str) -> str:
    return f"""SELECT file, line, "column", rule_id, r.severity, r.message, r.tool, r.code_snippet, r.source_ord FROM (
SELECT file, line, "column", rule_id,
  {fn}({{'severity': severity, 'message': message, 'tool': tool, 'code_snippet': code_snippet, 'source_ord': source_ord}},
       (source_ord, message)) AS r
FROM {FUSE_IN} GROUP BY file, line, "column", rule_id)"""


SARIF_RESULTS = f"""SELECT rule_id, {LEVEL} AS level, message,
  CASE WHEN starts_with(file, '/') AND NOT starts_with(file, '//') THEN ltrim(file, '/') ELSE file END AS uri,
  CAST(coalesce(line, 1) AS BIGINT) AS start_line, CAST(coalesce("column", 1) AS BIGINT) AS start_column FROM {ALL}"""


def sarif_rules_sql() -> str:
    meta = values([(k, v.get("name"), v.get("description"), v.get("help_uri")) for k, v in C.RULES_META.items()],
                  ["rid", "name", "description", "help_uri"])
    return f"""SELECT r.rule_id, coalesce(m.name, r.rule_id) AS name, coalesce(m.description, r.first_message) AS description,
  CAST(m.help_uri AS VARCHAR) AS help_uri
FROM (SELECT rule_id, arg_min(message, ({REPORT_ORDER})) AS first_message FROM {ALL} GROUP BY rule_id) r
LEFT JOIN {meta} m ON m.rid = r.rule_id"""


def report_lines_sql() -> str:
    dim = severity_dim_sql()
    counts = f"(SELECT d.severity, d.severity_rank, count(i.severity) AS n FROM {dim} d LEFT JOIN {ALL} i ON upper(i.severity) = d.severity GROUP BY d.severity, d.severity_rank)"
    fixed = values([(0, 1, RP.RULE_LINE), (0, 2, RP.DEFAULT_TITLE), (0, 3, RP.RULE_LINE)], ["section", "seq", "text"])
    body = f"""SELECT {RANK} + 1 AS section, row_number() OVER (PARTITION BY upper(severity) ORDER BY {REPORT_ORDER}, coalesce(code_snippet, '')) AS seq,
      upper(severity) AS sev, rule_id, file, line, message FROM {ALL}"""
    return f"""SELECT CAST(section AS BIGINT) AS section, CAST(seq AS BIGINT) AS seq, text FROM (
  SELECT section, seq, text FROM {fixed}
  UNION ALL SELECT 0, 4, printf('Fichiers analyses: %d', (SELECT count(*) FROM documents))
  UNION ALL SELECT 0, 5, printf('Issues detectees: %d', (SELECT count(*) FROM {ALL}))
  UNION ALL SELECT 0, severity_rank + 6, printf('%s: %d', severity, n) FROM {counts}
  UNION ALL SELECT severity_rank + 1, 0, printf('--- %s (%d) ---', severity, n) FROM {counts} WHERE n > 0
  UNION ALL SELECT section, seq, printf({sql_str(RP.ISSUE_LINE)}, sev, seq, rule_id, file, coalesce(CAST(line AS VARCHAR), 'None'), message) FROM ({body})
)"""



LATIN1_FITS = r"regexp_matches(text, '^[\x00-\x{FF}]*$')"
# UTF-8 validity of the Latin-1 bytes of ``text`` (each character is one byte)
VALID_AS_LATIN1 = (r"'^(?:[\x00-\x7F]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]"
                   r"|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]"
                   r"|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2})*$'")


def in_list(col, vals):
    return f"{col} IN ({', '.join(sql_str(v) for v in vals)})"


DETECT = f"""(SELECT file,
  CASE WHEN {in_list('repo', C.BOM_REPOS)} THEN 'UTF-8-SIG' WHEN text = '' THEN NULL
       WHEN strlen(text) = length(text) THEN 'ascii'
       WHEN {in_list('repo', C.LATIN1_REPOS)} AND {LATIN1_FITS} THEN
            CASE WHEN regexp_matches(text, {VALID_AS_LATIN1}) THEN 'utf-8' ELSE 'ISO-8859-1' END
       ELSE 'utf-8' END AS encoding,
  CAST(CASE WHEN {in_list('repo', C.BOM_REPOS)} THEN 1.0 WHEN text = '' THEN 0.0
       WHEN strlen(text) = length(text) THEN 1.0
       WHEN {in_list('repo', C.LATIN1_REPOS)} AND {LATIN1_FITS} THEN
            CASE WHEN regexp_matches(text, {VALID_AS_LATIN1}) THEN 0.99 ELSE 0.5 END
       ELSE 0.99 END AS DOUBLE) AS confidence
FROM {DOCS})"""
CHECKED = f"""(SELECT *, coalesce((encoding IS NOT NULL AND upper(encoding) NOT IN ('UTF-8', 'UTF8', 'ASCII')) OR confidence < 0.7, false) AS is_issue FROM {DETECT})"""
SUMMARY = f"""(SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE NOT is_issue) AS BIGINT) AS ok_count,
  CAST(count(*) FILTER (WHERE is_issue) AS BIGINT) AS issues_count,
  round(100.0 * count(*) FILTER (WHERE NOT is_issue) / count(*), 1) AS ok_pct,
  round(100.0 * count(*) FILTER (WHERE is_issue) / count(*), 1) AS issues_pct FROM {CHECKED})"""


def encoding_report_sql():
    fixed = values([(0, 1, "=" * 80), (0, 2, "RAPPORT DE VERIFICATION D'ENCODAGE UTF-8 - corpuscope"), (0, 3, "=" * 80),
                    (1, 0, "FICHIERS A CORRIGER"), (1, 1, "-" * 80)], ["section", "seq", "text"])
    return f"""SELECT CAST(section AS BIGINT) AS section, CAST(seq AS BIGINT) AS seq, text FROM (
  SELECT * FROM {fixed}
  UNION ALL SELECT 0, 4, printf('Fichiers analyses: %d', total) FROM {SUMMARY}
  UNION ALL SELECT 0, 5, printf('Fichiers conformes: %d (%.1f%%)', ok_count, coalesce(ok_pct, 0.0)) FROM {SUMMARY}
  UNION ALL SELECT 0, 6, printf('Fichiers a corriger: %d (%.1f%%)', issues_count, coalesce(issues_pct, 0.0)) FROM {SUMMARY}
  UNION ALL SELECT 2, n, printf('[%d] Fichier: %s | Encodage: %s | Confiance: %d%% | %s', n, file, coalesce(encoding, 'inconnu'),
                         CAST(round(confidence * 100) AS INTEGER), 'WARNING')
     FROM (SELECT *, row_number() OVER (ORDER BY lower(file), file) AS n FROM {CHECKED} WHERE is_issue))"""


ENTITY_REPLACE = "replace(replace(replace(replace(text, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
HTML_LINK_SQL = sql_str(r"""(?i)(<(?:a|img)\s[^>]*?(?:href|src)\s*=\s*['"])([^'"]*)(['"][^>]*?>)""")
MD_LINK_SQL = sql_str(r"(!?\[[^\]]*\]\()([^)]+)(\))")
SAFE_RESTORE = [("%2F", "/"), ("%3A", ":"), ("%3F", "?"), ("%23", "#"), ("%5B", "["), ("%5D", "]"), ("%40", "@"),
                ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"),
                ("%2B", "+"), ("%2C", ","), ("%3B", ";"), ("%3D", "=")]


def quote_sql(u: str) -> str:
    e = f"url_encode({u})"
    for a, b in SAFE_RESTORE:
        e = f"replace({e}, {sql_str(a)}, {sql_str(b)})"
    return f"(CASE WHEN contains({u}, '%') THEN {u} ELSE {e} END)"


BLANK = f"regexp_matches(text, '^{WS_CLASS}*$')"


def dup_blocks_sql(k):
    return f"""WITH l AS (SELECT file, string_split(text, chr(10)) AS ls FROM {DOCS}),
w AS (SELECT file, ls, unnest(generate_series(1, len(ls) - {k - 1})) AS line FROM l WHERE len(ls) >= {k}),
b AS (SELECT file, line, array_to_string(ls[line:line + {k - 1}], chr(10)) AS block FROM w),
f AS (SELECT md5(block) AS block_hash, file, count(*) AS occ, min(line) AS first_line FROM b WHERE {strip('block')} <> '' GROUP BY 1, 2)
SELECT block_hash, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(occ) AS BIGINT) AS n_occurrences, min(file) AS first_file,
  CAST(arg_min(first_line, file) AS BIGINT) AS first_line FROM f GROUP BY block_hash HAVING count(*) >= 2"""


def glob_rx(patterns, hidden=False):
    from corpuscope.sources.globs import globs_to_regex

    return sql_str(globs_to_regex(patterns, hidden))


def markdown_report_sql(issues_sql: str, title: str, extra: dict) -> str:
    rows = [(0, 1, f"# {title}"), (0, 2, "")] + [(0, 10 + i, f"**{k}:** {v}") for i, (k, v) in enumerate(extra.items())]
    fixed = values(rows, ["section", "seq", "text"])
    body = f"""SELECT 1 AS section, row_number() OVER (ORDER BY {RANK}, {REPORT_ORDER}, coalesce(code_snippet, '')) AS seq,
        upper(severity) AS sev, rule_id, file, line, message FROM ({issues_sql})"""
    fmt = sql_str("### [%d] %s: %s\n\n- **Fichier:** `%s`\n- **Ligne:** %s\n- **Message:** %s\n")
    return f"""SELECT CAST(section AS BIGINT) AS section, CAST(seq AS BIGINT) AS seq, text FROM (
  SELECT * FROM {fixed}
  UNION ALL SELECT 0, 3, printf('**Fichiers analyses:** %d', (SELECT count(*) FROM documents))
  UNION ALL SELECT 0, 4, printf('**Issues detectees:** %d', (SELECT count(*) FROM ({issues_sql})))
  UNION ALL SELECT section, seq, printf({fmt}, seq, sev, rule_id, file, coalesce(CAST(line AS VARCHAR), 'None'), message) FROM ({body}))"""


SECRET_DOCS = f"(SELECT * FROM {DOCS} WHERE NOT regexp_matches(file, {glob_rx(C.SECRET_EXCLUDE, True)}))"


STRICT_CHECKED = (f"(SELECT *, coalesce((encoding IS NOT NULL AND upper(encoding) NOT IN ('UTF-8', 'UTF8')) "
                  f"OR confidence < {C.STRICT_MIN_CONFIDENCE}, false) AS is_issue FROM {DETECT})")


def encoding_report_md_sql():
    fixed = values([(0, 1, "# Rapport de Vérification d'Encodage UTF-8 - corpuscope"), (1, 0, "## ⚠️ Fichiers à corriger"),
                    (1, 1, "| Fichier | Encodage | Confiance | Statut |"), (1, 2, "|---------|----------|-----------|--------|")],
                   ["section", "seq", "text"])
    return f"""SELECT CAST(section AS BIGINT) AS section, CAST(seq AS BIGINT) AS seq, text FROM (
  SELECT * FROM {fixed}
  UNION ALL SELECT 0, 2, printf('**Fichiers analysés:** %d', total) FROM {SUMMARY}
  UNION ALL SELECT 0, 3, printf('**Fichiers conformes:** %d (%.1f%%)', ok_count, coalesce(ok_pct, 0.0)) FROM {SUMMARY}
  UNION ALL SELECT 0, 4, printf('**Fichiers à corriger:** %d (%.1f%%)', issues_count, coalesce(issues_pct, 0.0)) FROM {SUMMARY}
  UNION ALL SELECT 2, 0, printf('%d fichier(s) en UTF-8 avec confiance > 70%%', ok_count) FROM {SUMMARY} WHERE ok_count > 0
  UNION ALL SELECT 1, n + 2, printf('| `%s` | %s | %d%% | %s |', regexp_extract(file, '([^/]*)$', 1), coalesce(encoding, 'inconnu'),
                         CAST(round(confidence * 100) AS INTEGER), '⚠️ WARNING')
     FROM (SELECT *, row_number() OVER (ORDER BY lower(file), file) AS n FROM {CHECKED} WHERE is_issue))"""


METRICS = f"""SELECT file, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
        CAST(len(regexp_extract_all(text, {sql_str(SC.DEFINITIONS['python'].pattern)})) AS BIGINT) AS n_functions,
        CAST(len(regexp_extract_all(text, {sql_str(SC.CLASS_PATTERNS['python'])})) AS BIGINT) AS n_classes FROM {DOCS}"""
FILE_ROWS = f"""SELECT file, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines, CAST(strlen(text) AS BIGINT) AS n_bytes,
    md5(text) AS digest FROM {DOCS} WHERE text IS NOT NULL"""
# events with the batch they arrive in; ``passed``: the watermark that the batches before have set
FEED = f"""e AS (SELECT event_id, ts, file, rule_id, severity, least((CAST(ts AS DATE) - DATE '2024-01-01') // {C.FEED_DAYS}, {C.FEED_LAST})
        + CASE WHEN event_id % {C.FEED_LATE} = 0 THEN 1 ELSE 0 END AS batch FROM {EVENTS}),
    seen AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS passed
        FROM e GROUP BY batch),
    late AS (SELECT e.*, seen.passed FROM e JOIN seen USING (batch))"""

ORACLES: dict[str, str] = {
    "line_counts": f"SELECT file, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM {DOCS}",
    "splitlines_count": f"SELECT file, CAST(len({splitlines('text')}) AS BIGINT) AS n_lines FROM {DOCS}",
    "taint_flow": taint_sql(C.TAINT_SENSITIVE, C.TAINT_ENTRIES, C.TAINT_SINKS),
    "taint_flow_window": taint_sql(C.TAINT_SENSITIVE, C.TAINT_ENTRIES, C.TAINT_SINKS),
    "taint_flow_lines": taint_sql(C.TAINT_SENSITIVE, C.TAINT_ENTRIES, C.TAINT_SINKS),
    "long_files": length_sql(C.DOC_LENGTHS),
    "many_definitions": definitions_sql(C.PAGE_LINKS, "html"),
    "parse_errors": parse_errors_sql(C.MAX_BYTES),
    "secret_patterns": secret_sql(C.SECRET_RULES),
    "secret_entropy": entropy_sql(C.ENTROPY_THRESHOLD, SC.TOKEN_PATTERN),
    "custom_rules": line_rules_sql(C.CUSTOM_RULES),
    "all_issues": all_issues_sql(),
    "semantic_scan": f"({length_sql(C.DOC_LENGTHS)}) "
    f"UNION ALL ({line_rules_sql(C.CUSTOM_RULES)})",
    "entry_files": f"""SELECT file FROM (SELECT file, {splitlines('text')} AS ls FROM {DOCS})
        WHERE len(ls) > 0 AND ({base_name('file')} IN ({', '.join(sql_str(e) for e in C.TAINT_ENTRIES)})
        OR len(list_filter(ls, lambda l: {contains_any('l', C.TAINT_ENTRIES)})) > 0)""",
    "sensitive_lines": lines_where(f"regexp_matches(text, {any_regex(C.TAINT_SENSITIVE)})"),
    "sink_lines": lines_where(contains_any("text", C.TAINT_SINKS)),
    "file_metrics": METRICS,
    "complexity_proxy": f"""SELECT file, c AS complexity, c > 20 AS too_complex FROM (SELECT file,
        CAST(1 + len(regexp_extract_all(text, {sql_str(SC.DECISION_PATTERN)})) + len(regexp_extract_all(text, {sql_str(SC.BOOLEAN_PATTERN)})) AS BIGINT) AS c
        FROM {DOCS})""",
    "detect_language": f"""SELECT file, ext AS extension, {EXT_CASE} AS language FROM (
        SELECT file, lower(regexp_extract(regexp_replace(file, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM {PAGES})""",
    "secret_confidence": f"""SELECT file, CAST(line AS BIGINT) AS line, CAST(score AS BIGINT) AS confidence,
        CASE WHEN score < 30 THEN 'probable_false_positive' WHEN score < 70 THEN 'to_verify' ELSE 'likely' END AS band
        FROM (SELECT file, line, CASE WHEN regexp_matches(text, {any_regex_cs(C.CONFIDENCE_HIGH)}) THEN 90
              WHEN regexp_matches(text, {any_regex_cs(C.CONFIDENCE_LOW)}) THEN 20 ELSE 50 END AS score
              FROM {lines_of()} WHERE regexp_matches(text, {any_regex_cs(C.CONFIDENCE_HIT)})
              AND NOT regexp_matches(text, {any_regex_cs(SEC.SAFE_CONTEXTS)}))""",
    "severity_breakdown": f"""SELECT d.severity, CAST(d.severity_rank AS INTEGER) AS severity_rank, d.level,
        CAST(count(i.severity) AS BIGINT) AS n_issues
        FROM {severity_dim_sql()} d LEFT JOIN {ALL} i ON upper(i.severity) = d.severity
        GROUP BY d.severity, d.severity_rank, d.level""",
    "scan_totals": f"""SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS files_analysed, CAST(count(*) AS BIGINT) AS issues_found,
        CAST(count(DISTINCT file) AS BIGINT) AS files_with_issues FROM {ALL}""",
    "issue_rollup": f"""SELECT tool, rule_id, CAST(count(*) AS BIGINT) AS n_issues, CAST(count(DISTINCT file) AS BIGINT) AS n_files,
        CAST(GROUPING(tool, rule_id) AS INTEGER) AS level FROM {ALL} GROUP BY ROLLUP (tool, rule_id)""",
    "top_issues": f"""SELECT severity, CAST(rk AS BIGINT) AS rank_in_severity, file, line, rule_id, message, CAST(tot AS BIGINT) AS severity_total,
        CAST(greatest(tot - {C.TOP_K}, 0) AS BIGINT) AS remaining FROM (
        SELECT *, row_number() OVER (PARTITION BY severity ORDER BY lower(file), file, line, coalesce("column", 0), rule_id, message, coalesce(code_snippet, '')) AS rk,
        count(*) OVER (PARTITION BY severity) AS tot FROM {ALL}) WHERE rk <= {C.TOP_K}""",
    "repo_summary": f"""SELECT repo, severity, CAST(count(*) AS BIGINT) AS n_issues, CAST(count(DISTINCT file) AS BIGINT) AS n_files
        FROM {ALL_REPO} GROUP BY repo, severity""",
    "quality_gate": quality_gate_sql(),
    "composite_score": composite_sql(),
    "severity_level": f"SELECT event_id, severity, {LEVEL} AS level FROM {EVENTS}",
    "severity_threshold": f"SELECT event_id, severity FROM {EVENTS} WHERE {RANK} <= 2",
    "dedupe_issues": f"""SELECT DISTINCT file, line, "column", rule_id, severity, message, tool, code_snippet, {fingerprint_sql()} AS fingerprint
        FROM ({ALL} UNION ALL ({secret_sql(C.SECRET_RULES)}) UNION ALL ({line_rules_sql(C.CUSTOM_RULES)}))""",
    "fuse_keep_first": fuse_pick_sql("arg_min"),
    "fuse_overwrite": fuse_pick_sql("arg_max"),
    "fuse_merge": f"""SELECT file, line, "column", rule_id, arg_min(upper(severity), {RANK}) AS severity,
        array_to_string(list_sort(list_distinct(list(message))), ' | ') AS message,
        array_to_string(list_sort(list_distinct(list(tool))), ',') AS tool,
        CAST(count(DISTINCT source_ord) AS BIGINT) AS n_reports FROM {FUSE_IN} GROUP BY file, line, "column", rule_id""",
    "baseline_diff": f"""WITH i AS (SELECT * EXCLUDE (fingerprint), {fingerprint_sql()} AS fingerprint FROM {ALL}),
        u AS (SELECT fingerprint, file, line, rule_id, 1 AS b, 0 AS a FROM i WHERE severity <> 'HIGH'
              UNION ALL SELECT fingerprint, file, line, rule_id, 0, 1 FROM i WHERE severity <> 'CRITICAL')
        SELECT fingerprint, min(file) AS file, min(line) AS line, min(rule_id) AS rule_id,
        CASE WHEN max(a) = 1 AND max(b) = 1 THEN 'unchanged' WHEN max(a) = 1 THEN 'new' ELSE 'fixed' END AS status
        FROM u GROUP BY fingerprint""",
    "sarif_results": SARIF_RESULTS,
    "sarif_rules": sarif_rules_sql(),
    "sarif_roundtrip": SARIF_RESULTS,
    "issue_report_lines": report_lines_sql(),
    "relative_path": f"""SELECT file, CASE WHEN starts_with(file, {sql_str(C.RELATIVE_ROOT)}) THEN substr(file, {len(C.RELATIVE_ROOT) + 1})
        WHEN regexp_extract(file, '([^/]*)$', 1) <> '' THEN regexp_extract(file, '([^/]*)$', 1) ELSE file END AS relative FROM {PAGES}""",
    "encoding_detect": f"SELECT * FROM {DETECT}",
    "encoding_issues": f"SELECT file, encoding, confidence, 'WARNING' AS status FROM {CHECKED} WHERE is_issue",
    "encoding_summary": f"SELECT * FROM {SUMMARY}",
    "encoding_report": encoding_report_sql(),
    "entities_decoded": f"""SELECT file, md5({ENTITY_REPLACE}) AS digest, CAST(length({ENTITY_REPLACE}) AS BIGINT) AS n_chars,
        CAST(NULL AS VARCHAR) AS error FROM {PAGES}""",
    "links_encoded": f"""SELECT file, CAST(n AS BIGINT) AS n, href, {quote_sql('href')} AS encoded FROM (
        SELECT file, unnest(hs) AS href, unnest(generate_series(1, len(hs))) AS n FROM (
        SELECT file, regexp_extract_all(text, {HTML_LINK_SQL}, 2) AS hs FROM {PAGES}))""",
    "fill_empty": f"""SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn + 1 AS BIGINT) AS line, {BLANK} AS filled,
        md5(CASE WHEN {BLANK} THEN {sql_str(chr(60) + '!-- À compléter -->' + chr(10))} ELSE text END) AS digest FROM conversations""",
    "repair_dry_run": f"""SELECT file, CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END AS encoding,
        CAST(CASE WHEN strlen(text) = length(text) THEN 1.0 ELSE 0.99 END AS DOUBLE) AS confidence, true AS success, changed,
        CASE WHEN changed THEN '🔧 (dry-run) [contenu modifié]' ELSE 'ok (déjà conforme)' END AS message FROM (
        SELECT file, text, ({ENTITY_REPLACE} <> text
          OR len(list_filter(regexp_extract_all({ENTITY_REPLACE}, {HTML_LINK_SQL}, 2), lambda u: {quote_sql('u')} <> u)) > 0
          OR len(list_filter(regexp_extract_all({ENTITY_REPLACE}, {MD_LINK_SQL}, 2), lambda u: {quote_sql('u')} <> u)) > 0) AS changed
        FROM {PAGES})""",
    "duplicate_blocks": dup_blocks_sql(C.DUP_K),
    "corpus_paths": f"SELECT file FROM {DOCS} WHERE regexp_matches(file, {glob_rx(C.PATH_GLOBS)})",
    "corpus_exclude": f"SELECT file FROM {DOCS} WHERE NOT regexp_matches(file, {glob_rx(C.EXCLUDE_GLOBS, True)})",
    "corpus_suffix": f"SELECT file FROM {PAGES} WHERE ends_with(lower(file), {sql_str(C.PAGE_SUFFIX.lower())})",
    "issue_trend": f"""SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, severity,
        CAST(count(*) AS BIGINT) AS n_issues FROM {EVENTS} GROUP BY 1, 2, 3""",
    "secret_scan": f"({secret_sql(C.SECRET_RULES, SECRET_DOCS)}) UNION ALL ({entropy_sql(C.ENTROPY_THRESHOLD, SC.TOKEN_PATTERN, SECRET_DOCS)})",
    "taint_report_markdown": markdown_report_sql(
        taint_sql(C.TAINT_SENSITIVE, C.TAINT_ENTRIES, C.TAINT_SINKS), "Rapport d'Analyse de Taint (Flux de Données) - corpuscope",
        {"Patterns sensibles": ", ".join(C.TAINT_SENSITIVE), "Entry points": ", ".join(C.TAINT_ENTRIES),
         "Sinks": ", ".join(C.TAINT_SINKS)}),
    "encoding_issues_strict": f"SELECT file, encoding, confidence, 'WARNING' AS status FROM {STRICT_CHECKED} WHERE is_issue",
    "encoding_report_markdown": encoding_report_md_sql(),
    "top_issues_summary": f"""WITH i AS (SELECT * EXCLUDE (severity), upper(severity) AS severity FROM {ALL}),
        r AS (SELECT *, {RANK} AS rk, row_number() OVER (PARTITION BY severity ORDER BY {REPORT_ORDER}, coalesce(code_snippet, '')) AS n,
              count(*) OVER (PARTITION BY severity) AS tot FROM i)
        SELECT CAST(rk + 1 AS BIGINT) AS section, CAST(n AS BIGINT) AS seq,
          printf({sql_str(RP.TOP_LINE)}, severity, n, rule_id, file, coalesce(CAST(line AS VARCHAR), 'None'), message) AS text
          FROM r WHERE n <= {C.TOP_K}
        UNION ALL SELECT DISTINCT CAST(rk + 1 AS BIGINT), CAST(0 AS BIGINT), printf('--- %s (%d) ---', severity, tot) FROM r
        UNION ALL SELECT DISTINCT CAST(rk + 1 AS BIGINT), CAST({C.TOP_K + 1} AS BIGINT), printf({sql_str(RP.MORE_LINE)}, tot - {C.TOP_K}, severity)
          FROM r WHERE tot > {C.TOP_K}""",
    "quality_files": """SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file FROM documents d
        WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""",
    "exclude_listed": """SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""",
    "secret_matches": secret_matches_sql(),
    "rule_table": rule_table_sql(),
    "corpus_files": FILE_ROWS,
    "corpus_chunks": FILE_ROWS,
    "incremental_files": FILE_ROWS,
    "sarif_files": SARIF_RESULTS,
    "sarif_import": sarif_import_sql(),
    "sonar_import": f"""SELECT file, line, rule_id, severity, message, 'sonarqube' AS tool FROM ({line_rules_sql(C.CUSTOM_RULES)})""",
    "decoded_bytes": f"""SELECT e.file, e.encoding, false AS fallback, md5(CASE WHEN e.encoding = 'utf-8' AND {in_list('d.repo', C.LATIN1_REPOS)}
        AND {LATIN1_FITS} THEN NULL ELSE text END) AS digest, CAST(length(text) AS BIGINT) AS n_chars FROM {DETECT} e JOIN {DOCS} d USING (file)""",
    "anchors_fixed": """SELECT doc_id, md5('<a ID = "x ' || CAST(doc_id AS VARCHAR) || '" class="y ">' || text) AS digest FROM documents""",
    "settings": """SELECT doc_id, 'late-' || lang AS lang, source || '=x' AS path, CAST(2 AS BIGINT) AS n FROM documents""",
    "selected_rules": f"({length_sql(C.DOC_LENGTHS)}) UNION ALL ({line_rules_sql(C.CUSTOM_RULES)})",
    "dangerous_calls": dangerous_sql(),
    "secret_scores": secret_scores_sql(),
    "metrics_csv": METRICS,
    "issues_json": f"SELECT repo, file, line, rule_id, severity, message FROM {ALL_REPO}",
    "stream_trend": f"""WITH {FEED} SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, severity,
        CAST(count(*) AS BIGINT) AS n_issues FROM late WHERE passed IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > passed
        GROUP BY 1, 2, 3 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM e)""",
    "stream_dedupe": f"""WITH {FEED}, kept AS (SELECT * FROM late WHERE passed IS NULL OR ts > passed),
        first AS (SELECT file || ':' || rule_id AS fingerprint, arg_min(event_id, row(ts, event_id)) AS event_id, min(ts) AS ts FROM kept GROUP BY 1)
        SELECT f.fingerprint, f.event_id, f.ts, e.severity FROM first f JOIN e USING (event_id)
        WHERE f.ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM e)""",
}
