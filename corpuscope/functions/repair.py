"""Content repairs (S-3 .. S-6) as native column expressions.

Link targets: a text is cut at its links, each target that needs it is form-encoded by Spark, and the characters that may
stand in a URL are put back. Character references are decoded by ``functions.references``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.bind import bind_sql, of_text, quoted, weave_sql
from corpuscope.functions.references import decode_references

# --- fixed values: repair patterns and texts (required behaviour) ---
MD_LINK = r"(!?\[[^\]]*\]\()([^)]+)(\))"
HTML_LINK = r"""(?i)(<(?:a|img)\s[^>]*?(?:href|src)\s*=\s*['"])([^'"]*)(['"][^>]*?>)"""
URL_SAFE = "/:?#[]@!$&'()*+,;=-._~"
EMPTY_PLACEHOLDER = "<!-- À compléter -->\n"
URL_UNSAFE = r"[^A-Za-z0-9/:?#\[\]@!$&'()*+,;=\-._~]"
ANCHOR_PATTERN = r'(?i)(\bid\s*=\s*"[^"]*?)\s+"'


def decode_entities(text: Column) -> Column:
    """S-3: ``struct(text, error)``."""
    return decode_references(text)


def _quoted_url(url: str) -> str:
    """SQL of ``quote_url``: form-encoding, undone for the characters that may stand in a URL."""
    out = f"replace(url_encode({url}), '+', '%20')"
    for c in URL_SAFE:
        out = f"replace({out}, '%{ord(c):02X}', {quoted(c)})"
    return f"if(not contains({url}, '%') and {url} rlike {quoted(URL_UNSAFE)}, {out}, {url})"


def quote_url(url: Column) -> Column:
    """Percent-quote what may not stand in a URL; one that holds a ``%`` is taken as quoted."""
    return of_text(url, "u", _quoted_url("u"))


def _requote(text: str, link: str) -> str:
    """The pieces between links as they are, each link with its target quoted."""
    before, target, after = (f"regexp_extract(m, {quoted(link)}, {g})" for g in (1, 2, 3))
    return weave_sql(text, link, "m", f"concat({before}, {bind_sql(target, 'u', _quoted_url('u'))}, {after})")


def encode_links(text: Column) -> Column:
    """S-5: targets of Markdown links, then of HTML links and images, quoted. Only texts that hold a sign of either are
    cut into pieces; quoting a Markdown target neither makes nor takes the sign of an HTML link."""
    markdown = f"if(contains(t, ']('), {_requote('t', MD_LINK)}, t)"
    html = f"if(contains(lower(t), 'href') or contains(lower(t), 'src'), {bind_sql(markdown, 'h', _requote('h', HTML_LINK))}, {markdown})"
    return of_text(text, "t", html)


def fix_anchor_ids(text: Column) -> Column:
    """S-4, documented intent: blanks before the closing quote of ``id="..."`` are removed
    (``id="xxx "`` -> ``id="xxx"``). A literal reading of the pattern would delete the quote after
    such a value; that corruption is deliberately not reproduced."""
    return F.regexp_replace(text, ANCHOR_PATTERN, '$1"')


BLANK_PATTERN = "(?U)^[\\s\\x1C-\\x1F]*$"


def fill_empty(text: Column) -> Column:
    """S-6: blank text (Unicode whitespace incl. NBSP and \\x1c-\\x1f) becomes a placeholder."""
    return F.when(text.rlike(BLANK_PATTERN), F.lit(EMPTY_PLACEHOLDER)).otherwise(text)
