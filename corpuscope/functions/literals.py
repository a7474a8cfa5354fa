"""What a text must contain for a regex to match: literals for gates and for the index of a rule table.

The analysis reads the pattern with Python's parser and gives up (no literal, no gate) on whatever Java may read in
another way, so a gate never loses a match.
"""

from __future__ import annotations

import re
import sys
import warnings
from re import _constants as rc
from re import _parser as rp

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# read differently by Java: octal escapes, \\Z and \\z, quoting, classes with operators, verbose and other inline flags
_UNSURE = re.compile(r"\\[0-9ZzQEeGKRXhHvVNpPacxk]|&&|\[[^\]]*\[|\(\?[a-zA-Z]*[^imsu:=!<>)a-zA-Z]|\(\?[a-zA-Z-]*[^imsuU:)<=!>-][a-zA-Z-]*[:)]|\(\?P")
TELLING = 3  # characters of a literal that few texts hold
_PLAIN = {"LITERAL", "NOT_LITERAL", "ANY", "IN", "MAX_REPEAT", "MIN_REPEAT", "SUBPATTERN", "BRANCH"}


def _parse(pattern: str):
    """The parsed pattern and its flags ``(ignore case, of Unicode)``; None if Java may read it otherwise."""
    if _UNSURE.search(pattern):
        return None
    inline = re.findall(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?[:)]", pattern)
    if any(off for _, off in inline):
        return None
    flags = {c for on, _ in inline for c in on}
    # Python wants global flags at the start only; they are read above
    bare = re.sub(r"\(\?[a-zA-Z]+\)", "", pattern)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return rp.parse(re.sub(r"\(\?[a-zA-Z]+:", "(?:", bare)), "i" in flags, bool(flags & {"u", "U"})
    except (re.error, OverflowError, Warning, RecursionError):
        return None


def _usable(c: int, ignore_case: bool, unicode: bool) -> str | None:
    """The character as it stands in the text (lower-cased if case is ignored), if it has no other forms."""
    ch = chr(c)
    if not ignore_case:
        return ch
    if c > 127 or (unicode and ch.lower() in "si"):  # long s and dotless i fold to ASCII
        return None
    return ch.lower()


def _alternatives(tree, ic: bool, uni: bool) -> list[frozenset[str]]:
    """Sets of literals: a match contains one literal of each set."""
    out, run = [], ""

    def close():
        nonlocal run
        if run:
            out.append(frozenset([run]))
        run = ""

    for op, arg in tree:
        if op is rc.LITERAL and (ch := _usable(arg, ic, uni)) is not None:
            run += ch
            continue
        if op is rc.SUBPATTERN and arg[1] == 0 and arg[2] == 0 and all(o is rc.LITERAL for o, _ in arg[3]):
            chars = [_usable(a, ic, uni) for _, a in arg[3]]
            if None not in chars:
                run += "".join(chars)
                continue
        close()
        if op is rc.SUBPATTERN and arg[1] == 0 and arg[2] == 0:
            out += _alternatives(arg[3], ic, uni)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
            out += _alternatives(arg[2], ic, uni)
        elif op is rc.BRANCH:
            best = [_best(_alternatives(b, ic, uni)) for b in arg[1]]
            if all(best):
                out.append(frozenset().union(*best))
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 4:
            chars = [_usable(a, ic, uni) for _, a in arg]
            if None not in chars:
                out.append(frozenset(chars))
    close()
    return out


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    """The most selective set: its shortest literal is longest, then it has the fewest."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def required_literals(pattern: str) -> tuple[frozenset[str], bool] | None:
    """``(literals, ignore_case)``: every match contains one of the literals (of the lower-cased text if case is
    ignored). None if the pattern requires none that can be told."""
    parsed = _parse(pattern)
    if parsed is None:
        return None
    tree, ic, uni = parsed
    best = _best(_alternatives(tree, ic, uni))
    return (best, ic) if best else None


def matches_inside(pattern: str) -> bool:
    """Whether a match in a line is also found in the text around it: the pattern has no anchors, look-around, atomic
    parts or back references."""
    parsed = _parse(pattern)
    if parsed is None:
        return False

    def plain(tree) -> bool:
        for op, arg in tree:
            if op.name not in _PLAIN:
                return False
            if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and not plain(arg[2]):
                return False
            if op is rc.SUBPATTERN and not plain(arg[3]):
                return False
            if op is rc.BRANCH and not all(plain(b) for b in arg[1]):
                return False
        return True

    return plain(parsed[0])


def text_gate(text: Column, patterns) -> Column | None:
    """True of every text with a line that one of the patterns matches; None if no such test is cheaper than the search
    (some pattern has neither a literal nor a form that may be searched in whole texts)."""
    gates = []
    for p in patterns:
        need = required_literals(p)
        weak = need is None or min(map(len, need[0])) < TELLING
        if weak and matches_inside(p):
            gates.append(text.rlike(p))
        elif need is not None:
            literals, ignore_case = need
            held = F.lower(text) if ignore_case else text
            gates += [held.contains(lit) for lit in sorted(literals)]
        else:
            return None
    out = gates[0]
    for g in gates[1:]:
        out = out | g
    return out
