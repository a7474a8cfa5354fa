"""The README coverage table names every registered query; every query has an oracle."""

import os

import __spark_entry__ as E
from corpuscope.plans.catalog import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_readme_lists_every_query():
    readme = open(os.path.join(ROOT, "README.md"), encoding="utf-8").read()
    assert [k for k in E.queries() if f"`{k}`" not in readme] == []
    assert f"({len(QUERIES)} queries, all" in readme


def test_no_forbidden_names():
    for top in ("corpuscope", "tests", "tools"):
        for d, _, files in os.walk(os.path.join(ROOT, top)):
            for f in files:
                assert not f.startswith("op") or not f[2:3].isdigit()
