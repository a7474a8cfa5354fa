"""corpuscope: scan, flag, repair, fuse and report on large text and code corpora with Spark.

Every operator takes and returns DataFrames. Per-file rules are column expressions (map-only,
no shuffle); shuffles happen only where the semantics need them (summaries, fusing, duplicate
detection, numbering) and are written so a hot key cannot land whole in one task.

Common entry points::

    from corpuscope import read_corpus, as_text_corpus, scan, TaintRule, severity_breakdown
"""

from corpuscope.operators.fuse import baseline_diff, dedupe, fuse, union_reports  # noqa: F401
from corpuscope.operators.scan import (  # noqa: F401
    DefinitionCountRule,
    EntropyRule,
    FileLengthRule,
    LineRule,
    LineRulesRule,
    Rule,
    SecretPattern,
    SecretPatternRule,
    TaintRule,
    scan,
)
from corpuscope.operators.summary import severity_breakdown, top_issues  # noqa: F401
from corpuscope.schema import ISSUE_COLUMNS, ISSUE_SCHEMA, SEVERITIES, issue_frame  # noqa: F401
from corpuscope.sinks.sarif import sarif_logs, write_sarif  # noqa: F401
from corpuscope.sources.files import as_text_corpus, read_corpus, stream_corpus  # noqa: F401

__version__ = "0.1.0"
