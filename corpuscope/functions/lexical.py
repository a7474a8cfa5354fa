"""R-2: strings and comments blanked in one pass, natively, before definitions are counted.

One alternation per language finds the next string or comment from left to right, so a quote in a comment and a comment
sign in a string are seen as what they are. Each is replaced by a blank; line feeds inside go with it, and text outside is
not touched. Loops are possessive over whole stretches, so the length of a string does not deepen the match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(quote: str, lines: bool = False) -> str:
    """A string in single quotes of its kind with backslash escapes; it ends at the line's end unless ``lines``. A quote
    that nothing closes is left alone, but for its sign."""
    stop = "" if lines else r"\n"
    return rf"{quote}[^{quote}\\{stop}]*+(?:\\[\s\S][^{quote}\\{stop}]*+)*+{quote}"


def _fenced(fence: str) -> str:
    return rf"{fence}[\s\S]*?{fence}"


# --- fixed values: how strings and comments are written ---
BLANKED = {
    "python": [_fenced('"""'), _fenced("\'\'\'"), _quoted('"'), _quoted("'"), r"#[^\n]*+"],
    "java": [r"/\*[\s\S]*?\*/", r"//[^\n]*+", _fenced('"""'), _quoted('"'), _quoted("'")],
    "php": [r"/\*[\s\S]*?\*/", r"//[^\n]*+", r"#(?!\[)[^\n]*+", r"<<<[ \t]*+(['\"]?)(\w++)\1[ \t]*+\n[\s\S]*?\n[ \t]*+\2\b", _quoted('"', True), _quoted("'", True)],
}


def blank_literals(text: Column, lang: str) -> Column:
    """``text`` without its strings and comments; languages without a description come back as they are."""
    forms = BLANKED.get(lang.lower())
    return text if forms is None else F.regexp_replace(text, "|".join(forms), " ")
