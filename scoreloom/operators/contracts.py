"""Declared contracts of tables: presence, least rows, keys, filled columns and references, each told with its count of faults."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "table_name string, rule string, bad long, passed boolean"


class Reference(NamedTuple):
    """``columns`` have to stand in ``of`` (a table) as ``keys``; nulls refer to nothing."""

    columns: tuple
    of: str
    keys: tuple


class Contract(NamedTuple):
    table: str
    key: tuple
    filled: tuple = ()
    least: int = 1
    references: tuple = ()

    def rules(self) -> list[str]:
        return [
            "present", f"rows>={self.least}", f"unique:{','.join(self.key)}", *(f"filled:{c}" for c in self.filled),
            *(f"reference:{','.join(r.columns)}->{r.of}" for r in self.references),
        ]


def _loaded(load: Callable[[str], DataFrame], name: str) -> DataFrame | None:
    try:
        return load(name)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error) or "TABLE_OR_VIEW_NOT_FOUND" in str(error):
            return None
        raise


def evaluate(spark: SparkSession, load: Callable[[str], DataFrame], contracts: list[Contract]) -> DataFrame:
    """(table_name, rule, bad, passed): a row for each rule. ``bad`` counts missing rows, rows beyond the first of a key, nulls, or
    dangling references; rules of a table or column that is absent fail with a null count.

    Rows, keys and nulls of a table are one pass: keys are grouped first, and the groups summed.
    """
    out = spark.createDataFrame([], RULES)
    for c in contracts:
        df = _loaded(load, c.table)
        known = set(df.columns) if df is not None else set()
        told = spark.createDataFrame([(c.table, "present", 0 if df is not None else None, df is not None)], RULES)
        absent = [r for r in c.rules()[1:] if df is None]
        if df is not None:
            filled = [x for x in c.filled if x in known]
            absent += [f"filled:{x}" for x in c.filled if x not in known]
            keyed = set(c.key) <= known
            absent += [] if keyed else [c.rules()[2]]
            nulls = [F.count_if(F.col(x).isNull()).alias(f"n_{x}") for x in filled]
            grouped = df.groupBy(*c.key) if keyed else df.groupBy()
            one = grouped.agg(F.count(F.lit(1)).alias("n"), *nulls).agg(
                F.greatest(F.lit(c.least) - F.coalesce(F.sum("n"), F.lit(0)), F.lit(0)).alias("short"),
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("again"),
                *(F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(f"n_{x}") for x in filled),
            )
            pairs = [(c.rules()[1], "short"), *([(c.rules()[2], "again")] if keyed else []), *((f"filled:{x}", f"n_{x}") for x in filled)]
            each = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(n).cast("long").alias("bad")) for rule, n in pairs)))
            counted = one.select(each.alias("r")).select(F.lit(c.table).alias("table_name"), "r.rule", "r.bad", (F.col("r.bad") == 0).alias("passed"))
            told = told.unionByName(counted)
            for r, rule in zip(c.references, c.rules()[3 + len(c.filled) :]):
                other = _loaded(load, r.of)
                if other is None or not set(r.columns) <= known or not set(r.keys) <= set(other.columns):
                    absent.append(rule)
                    continue
                keys = other.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(r.keys)))
                held = df.select(*(F.col(x).alias(f"c{i}") for i, x in enumerate(r.columns))).na.drop()
                on = [F.col(f"c{i}") == F.col(f"k{i}") for i in range(len(r.keys))]
                left = held.groupBy(*held.columns).agg(F.count(F.lit(1)).alias("n")).join(keys, on, "left_anti")
                one = left.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad"))
                told = told.unionByName(one.select(F.lit(c.table).alias("table_name"), F.lit(rule).alias("rule"), "bad", (F.col("bad") == 0).alias("passed")))
        if absent:
            told = told.unionByName(spark.createDataFrame([(c.table, r, None, False) for r in absent], RULES))
        out = out.unionByName(told)
    return out


def as_sql(contracts: list[Contract]) -> str:
    """The same rules as one SQL text over tables that are present."""
    parts = []

    def add(table: str, rule: str, bad: str) -> None:
        parts.append(f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(({bad}) AS BIGINT) AS bad")

    for c in contracts:
        names = c.rules()
        add(c.table, "present", "0")
        add(c.table, names[1], f"SELECT greatest({c.least} - count(*), 0) FROM {c.table}")
        add(c.table, names[2], f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {c.table} GROUP BY {', '.join(c.key)})")
        for x in c.filled:
            add(c.table, f"filled:{x}", f"SELECT count(*) - count({x}) FROM {c.table}")
        for r, rule in zip(c.references, names[3 + len(c.filled) :]):
            some = " AND ".join(f"{x} IS NOT NULL" for x in r.columns)
            same = " AND ".join(f"o.{k} = x.{x}" for k, x in zip(r.keys, r.columns))
            add(c.table, rule, f"SELECT count(*) FROM {c.table} x WHERE {some} AND NOT EXISTS (SELECT 1 FROM {r.of} o WHERE {same})")
    return "SELECT *, bad = 0 AS passed FROM (" + "\nUNION ALL ".join(parts) + ")"
