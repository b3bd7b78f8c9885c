"""Drift of the shape of landed JSON documents from run to run.

The shape of a run is one schema, merged from its documents by partial
aggregation, so a run of any size and a source with most of the documents cost a
schema per task. Everything after that is one row per source and run.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_SIGN = re.compile(r"\s*(?:(?P<open>OBJECT<|ARRAY<)|(?P<close>>)|,|(?P<name>`(?:[^`]|``)*`|[^\s:<>,`]+):\s|(?P<kind>[A-Z_]+(?:\(\d+,\s*\d+\))?))")
# Kinds of JSON values; numbers differ in width only.
_KINDS = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "VARIANT": "mixed"}


def schema_paths(schema: str) -> list[tuple[str, str]]:
    """(path, kind) of every part of a variant's schema; elements of an array end in ``[]``."""
    out: list[tuple[str, str]] = []
    path, above = "$", []
    for sign in _SIGN.finditer(schema):
        if sign["open"]:
            above.append(path)
            if sign["open"] == "ARRAY<":
                out.append((path, "array"))
                path += "[]"
            else:
                out.append((path, "object"))
        elif sign["close"]:
            path = above.pop()
        elif sign["name"]:
            name = sign["name"]
            name = name[1:-1].replace("``", "`") if name[0] == "`" else name
            path = f"{above[-1]}.{name}"
        elif sign["kind"]:
            out.append((path, _KINDS.get(sign["kind"].split("(")[0], "number")))
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _paths(schemas: pd.Series) -> pd.Series:
    return schemas.map(lambda s: dict(schema_paths(s)) if s else {})


def run_shapes(documents: DataFrame, by: Sequence[str], run: str = "run_date", text: str = "payload") -> DataFrame:
    """Shape of each run: ``documents``, ``broken`` ones, and ``paths`` (path to kind).

    Documents that are null, empty or no JSON count as broken and have no part in
    the shape; a run of such alone has no paths. Text after a whole document is
    passed over, as Spark's JSON parser does.
    """
    value = F.try_parse_json(F.col(text))
    read = documents.select(*by, run, value.alias("_value"))
    out = read.groupBy(*by, run).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("_value").isNull()).alias("broken"),
        F.expr("schema_of_variant_agg(_value) FILTER (WHERE _value IS NOT NULL)").alias("_schema"),
    )
    whole = F.when(F.col("documents") > F.col("broken"), F.col("_schema"))
    return out.withColumn("paths", _paths(whole)).drop("_schema")


def shape_drift(shapes: DataFrame, by: Sequence[str], run: str = "run_date") -> DataFrame:
    """Paths that were added, removed or changed in kind since the run before.

    A run without any readable document is passed over, as it says nothing about
    the shape; the first run of a source has nothing to compare with. Nulls among
    ``by`` form a source of their own.
    """
    told = shapes.where(F.size("paths") > 0)
    w = Window.partitionBy(*by).orderBy(run)
    pairs = told.withColumns({"previous_run": F.lag(run).over(w), "_old": F.lag("paths").over(w)}).where("_old IS NOT NULL")
    every = F.array_union(F.map_keys("_old"), F.map_keys("paths"))
    rows = pairs.select(*by, run, "previous_run", F.explode(every).alias("path"), "_old", "paths")
    both = rows.select(
        *by,
        run,
        "previous_run",
        "path",
        F.try_element_at("_old", "path").alias("old_kind"),
        F.try_element_at("paths", "path").alias("new_kind"),
    )
    change = F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old_kind").eqNullSafe(F.col("new_kind"))).withColumn("change", change)
