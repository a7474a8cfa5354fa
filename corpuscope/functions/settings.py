"""F-KV: ``key=value`` settings (plugin options) as a map; split on the first ``=`` only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settings_map(items: Column) -> Column:
    """``ARRAY<STRING>`` of ``k=v`` -> ``MAP<STRING,STRING>`` (``a=b=c`` gives ``a -> b=c``; later
    keys win; items without ``=`` are ignored)."""
    kv = F.filter(items, lambda x: x.contains("="))
    entries = F.transform(
        kv,
        lambda x: F.struct(
            F.substring_index(x, "=", 1).alias("key"),
            F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("value"),
        ),
    )
    # keep the last occurrence of each key (map_from_entries rejects duplicates)
    last = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.exists(
            F.transform(entries, lambda o, j: F.struct(o["key"].alias("key"), j.alias("j"))),
            lambda o: (o["key"] == e["key"]) & (o["j"] > e["i"]),
        ),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def settings_string_map(text: Column, pair_delim: str = ",") -> Column:
    """``"k1=v1,k2=v2"`` -> map with Spark's ``str_to_map`` (first ``=`` splits)."""
    return F.str_to_map(text, F.lit(pair_delim), F.lit("="))
