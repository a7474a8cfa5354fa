"""A SARIF log cut into smaller ones while it is read, so no log must fit into one value.

One pass learns what each run holds besides its results (its tool and files, whose order in the log is free), a second
one gives the results in groups, each as a log with what its run holds. Memory is that of one group and of the runs'
other members.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

READ_BYTES = 1 << 20
TOKEN = re.compile(r'\s*+("[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s"{}\[\],:]++)', re.S)


def _tokens(read: Callable[[int], bytes]) -> Iterator[str]:
    """JSON tokens of a stream; one that a read cuts is put together first."""
    decode = codecs.getincrementaldecoder("utf-8-sig")()
    held = ""
    while True:
        more = read(READ_BYTES)
        held += decode.decode(more, not more)
        end = 0
        # a string that is not closed matches nothing; a number or word at the end may go on
        while (m := TOKEN.match(held, end)) and not (more and m.end() == len(held) and m[1] not in "{}[],:"):
            yield m[1]
            end = m.end()
        held = held[end:]
        if not more:
            if held.strip():
                raise ValueError("the log ends inside a value")
            return


def members(read: Callable[[int], bytes]) -> Iterator[tuple[int, str, str]]:
    """``(run, name, JSON)`` of every member of every run; each element of its results comes by itself."""
    path: list[tuple[str, str]] = []  # open containers: their sign and, in an object, the key of the value to come
    key, run, parts, depth = "", -1, None, 0
    before = ""
    for t in _tokens(read):
        if parts is not None:  # inside a value that is wanted whole
            parts.append(t)
            depth += (t in "{[") - (t in "}]")
            if depth == 0:
                yield run, name, "".join(parts)
                parts = None
                before = "value"
            continue
        inside = path[-1][0] if path else ""
        if inside == "{" and before in ("{", ",") and t[0] == '"':
            key, before = json.loads(t), "key"
        elif t in "}]":
            path.pop()
            before = "value"
        elif t in ",:":
            before = t
        else:
            where = [c for c in path]
            in_runs = len(where) >= 2 and where[0] == ("{", "runs") and where[1][0] == "["
            if len(where) == 2 and in_runs and t == "{":
                run += 1
            # a member of a run (but its list of results), or an element of that list
            member = len(where) == 3 and in_runs and inside == "{" and not (key == "results" and t == "[")
            element = len(where) == 4 and in_runs and where[2] == ("{", "results") and inside == "["
            if member or element:
                name = "results" if element else key
                if t in "{[":
                    parts, depth = [t], 1
                else:
                    yield run, name, t
                    before = "value"
                continue
            if path and inside == "{":
                path[-1] = ("{", key)
            if t in "{[":
                path.append((t, ""))
                before = t
            else:
                before = "value"


def split_log(open_read: Callable, most: int) -> Iterator[str]:
    """Logs of at most about ``most`` characters of results each, in order; a run without results gives one."""
    heads: dict[int, dict[str, str]] = {}
    with open_read() as f:
        for run, name, raw in members(f.read):
            if name != "results":
                heads.setdefault(run, {})[name] = raw
            else:
                heads.setdefault(run, {})

    def log(run: int, results: list[str]) -> str:
        inner = [f"{json.dumps(k)}:{v}" for k, v in heads[run].items()] + [f'"results":[{",".join(results)}]']
        return f'{{"version":"2.1.0","runs":[{{{",".join(inner)}}}]}}'

    group, size, now = [], 0, None
    with open_read() as f:
        for run, name, raw in members(f.read):
            if name != "results":
                continue
            if group and (run != now or size + len(raw) > most):
                yield log(now, group)
                group, size = [], 0
            group.append(raw)
            size += len(raw)
            now = run
    if group:
        yield log(now, group)
