"""Glob patterns as regular expressions that both Java (Spark) and RE2 accept.

Semantics follow Python's ``glob`` with ``recursive=True``: ``**`` as a whole component matches
zero or more directories, ``*`` and ``?`` stay inside one component, ``[seq]`` / ``[!seq]`` are
classes. Hidden names (leading ``.``) are not matched by a leading wildcard unless
``include_hidden``. The regex is applied to paths with ``rlike`` in executors.
"""

from __future__ import annotations

import re
import sys
from typing import Iterable

from pyspark import cloudpickle

# Code below runs in Python workers: ship this module with the function (by value), so
# executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = re.compile(r"[*?\[]")


def glob_to_regex(pattern: str, include_hidden: bool = False) -> str:
    out = []
    i, n = 0, len(pattern)
    comp_start = True
    while i < n:
        c = pattern[i]
        if c == "*" and pattern[i : i + 2] == "**" and comp_start and (i + 2 == n or pattern[i + 2] == "/"):
            if i + 2 == n:
                out.append(".*" if include_hidden else "(?:[^/.][^/]*(?:/[^/.][^/]*)*)?")
                i += 2
            else:
                out.append("(?:.*/)?" if include_hidden else "(?:[^/.][^/]*/)*")
                i += 3
            comp_start = True
            continue
        if c == "*":
            out.append("[^/]*" if (include_hidden or not comp_start) else "(?:[^/.][^/]*)?")
        elif c == "?":
            out.append("[^/]" if (include_hidden or not comp_start) else "[^/.]")
        elif c == "[":
            j = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("!", "]") else i + 1)
            if j == -1:
                out.append(re.escape(c))
            else:
                body = pattern[i + 1 : j]
                neg = body.startswith("!")
                body = body[1:] if neg else body
                body = body.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
                out.append(("[^/" if neg else "[") + body + "]")
                i = j
        elif c == "/":
            out.append("/")
            comp_start = True
            i += 1
            continue
        else:
            out.append(_escape(c))
        comp_start = False
        i += 1
    return "^" + "".join(out) + "$"


def _escape(c: str) -> str:
    return "\\" + c if c in ".^$+{}()|\\" else c


def globs_to_regex(patterns: Iterable[str], include_hidden: bool = False) -> str:
    """One alternation for several globs (union of matches, duplicates impossible)."""
    pats = list(patterns)
    if not pats:
        raise ValueError("at least one pattern is required")
    return "|".join(f"(?:{glob_to_regex(p, include_hidden)})" for p in pats)
