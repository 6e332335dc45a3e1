"""Comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: rows shown per section of a diff report.
SAMPLE = 50


def keyed_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per difference: ``keys..., change, field, before, after``.

    ``change`` is added, removed or changed; a changed row appears once per
    differing field, an added or removed row once with an empty field.  One full
    outer join on the key; values are compared null-safe in their own type and
    only shown as text.  Rows that share a key are numbered by their values on
    each side and compared number by number, so equal sides have no difference.
    """
    fields = [c for c in before.columns if c not in keys and c in after.columns]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*fields) if fields else Window.partitionBy(*keys).orderBy(*keys))
    old = before.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct(*fields).alias("_b"), number.alias("_b_no"))
    new = after.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.struct(*fields).alias("_a"), number.alias("_a_no"))
    match = F.expr(" AND ".join([*[f"_b_{k} <=> _a_{k}" for k in keys], "_b_no = _a_no"]))
    joined = old.join(new, match, "full")
    text = "STRING"
    none = f"cast(NULL AS {text})"

    def entry(change: str, field: str, b: str, a: str) -> str:
        return f"named_struct('change', '{change}', 'field', {field}, 'before', {b}, 'after', {a})"

    changed = [
        f"CASE WHEN NOT (_b.{f} <=> _a.{f}) THEN "
        + entry("changed", f"'{f}'", f"cast(_b.{f} AS {text})", f"cast(_a.{f} AS {text})")
        + " END"
        for f in fields
    ]
    whole = (
        f"CASE WHEN _b_no IS NULL THEN array({entry('added', none, none, none)}) "
        f"WHEN _a_no IS NULL THEN array({entry('removed', none, none, none)}) "
        f"ELSE filter(array({', '.join(changed)}), x -> x IS NOT NULL) END"
    )
    # the outer form: before an inner one Spark also filters on the list's size, which compares every row again
    found = joined.selectExpr(*[f"coalesce(_b_{k}, _a_{k}) AS {k}" for k in keys], f"inline_outer({whole})")
    return found.filter("change IS NOT NULL")


def diff_totals(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per kind of change."""
    return (
        diff.select(*keys, "change").distinct().groupBy("change").agg(F.count(F.lit(1)).alias("rows"))
    )


def diff_sample(diff: DataFrame, keys: Sequence[str], change: str, limit: int = SAMPLE) -> DataFrame:
    """All differences of the first ``limit`` keys of one kind, for a report."""
    own = diff.filter(F.col("change") == change)
    names = [f"_k{i}" for i in range(len(keys))]
    first = own.select(*[F.col(k).alias(n) for k, n in zip(keys, names)]).distinct().orderBy(*names).limit(limit)
    return own.join(first, F.expr(" AND ".join(f"{k} <=> {n}" for k, n in zip(keys, names))), "left_semi").orderBy(*keys, "field")


def keyless_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows present on one side only, with ``change`` added or removed.

    Rows are compared as a whole; one aggregate over both sides instead of two
    set differences, so each side is read once.
    """
    columns = before.columns
    both = before.selectExpr(*columns, "1 AS _old", "0 AS _new").unionByName(
        after.selectExpr(*columns, "0 AS _old", "1 AS _new")
    )
    sides = both.groupBy(*columns).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return sides.filter("_old <> _new").selectExpr(*columns, "CASE WHEN _new = 1 THEN 'added' ELSE 'removed' END AS change")


def compare_marts(baseline: dict[str, DataFrame], iteration: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """A keyed diff per mart both sides have (a failed iteration simply lacks the mart)."""
    shared = [m for m in keys if m in baseline and m in iteration]
    return {m: keyed_diff(baseline[m].drop("run_id"), iteration[m].drop("run_id"), keys[m]) for m in shared}
