"""Key operators: duplicates, orphans, dedupe, insert-if-absent.

All of them aggregate by key *before* anything is joined.  Partial aggregation
runs on the map side, so a key holding a third of the rows reaches the shuffle
as one row per input task instead of flooding a single reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.operators.checks import Ref


def complete(columns: Sequence[str]) -> str:
    return "(" + " AND ".join(f"{c} IS NOT NULL" for c in columns) + ")"


def all_equal(left: Sequence[str], right: Sequence[str], operator: str = "=") -> Column:
    return F.expr(" AND ".join(f"{a} {operator} {b}" for a, b in zip(left, right)))


def renamed(columns: Sequence[str], names: Sequence[str]) -> list[str]:
    return [f"{c} AS {n}" for c, n in zip(columns, names)]


def group_sizes(df: DataFrame, keys: Sequence[str], size: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.expr(f"count(1) AS {size}"))


def repeated_by_digest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose 64-bit key digest occurs more than once.

    A digest collision only keeps rows that the exact grouping afterwards tells
    apart, so nothing is lost or invented; distinct values never travel.
    """
    digest = F.expr(f"xxhash64({', '.join(keys)})").alias("_digest")
    repeated = group_sizes(df.select(digest), ["_digest"]).filter("cnt > 1").select("_digest")
    return df.select("*", digest).join(repeated, "_digest", "left_semi").drop("_digest")


def duplicated(df: DataFrame, keys: Sequence[str], count_null_keys: bool = True, wide: bool = False) -> DataFrame:
    """Duplicate key groups with their size."""
    kept = df if count_null_keys else df.filter(complete(keys))
    kept = kept.select(*keys)
    return group_sizes(repeated_by_digest(kept, keys) if wide else kept, keys).filter("cnt > 1")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``order``, then by the remaining columns.

    An aggregate rather than ``row_number`` so that the copies of a hot key are
    reduced before the shuffle.  ``order`` columns need not be kept.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not rest and not order:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.expr(f"min(struct({', '.join([*order, *rest])})) AS _first"))
    return picked.selectExpr(*[c if c in keys else f"_first.{c} AS {c}" for c in df.columns])


def insert_if_absent(existing: DataFrame, arriving: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Arriving rows whose key the table does not hold yet, one per key.

    The caller appends the result: rows already stored are never touched.
    """
    first = first_per_key(arriving, keys, order)
    return first.join(existing.select(*keys), list(keys), "left_anti")


def reference_counts(child: DataFrame, refs: Sequence[Ref]) -> DataFrame:
    """Rows per referenced key for foreign keys that share one parent: ``_k0.._kn, _n0.._nm``.

    One scan of the child serves every reference (roles of one dimension are
    unpivoted); the result is hash-partitioned by the key, which the join with
    the parent then reuses.
    """
    names = [f"_k{i}" for i in range(len(refs[0].columns))]
    if len(refs) == 1:
        return child.selectExpr(*renamed(refs[0].columns, names)).groupBy(*names).agg(F.expr("count(1) AS _n0"))
    roles = []
    for pos, ref in enumerate(refs):
        cells = ", ".join(f"'{n}', {c}" for c, n in zip(ref.columns, names))
        roles.append(f"named_struct('_r', {pos}, {cells})")
    keyed = child.selectExpr(f"inline(array({', '.join(roles)}))")
    return keyed.groupBy(*names).agg(*[F.expr(f"count_if(_r = {pos}) AS _n{pos}") for pos in range(len(refs))])


def without_parent(keyed: DataFrame, names: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Rows of ``keyed`` with no equal parent key; an incomplete key never has one."""
    aliases = [f"_p{i}" for i in range(len(parent_columns))]
    return keyed.join(parent.selectExpr(*renamed(parent_columns, aliases)), all_equal(names, aliases), "left_anti")


def orphan_totals(child: DataFrame, parent: DataFrame, refs: Sequence[Ref]) -> DataFrame:
    """One row: ``_n0.._nm`` orphan rows per reference."""
    counted = reference_counts(child, refs)
    names = [c for c in counted.columns if c.startswith("_k")]
    lost = without_parent(counted, names, parent, refs[0].parent_columns)
    totals = []
    for pos, ref in enumerate(refs):
        rows = f"_n{pos}" if ref.null_is_orphan else f"CASE WHEN {complete(names)} THEN _n{pos} END"
        totals.append(f"coalesce(sum({rows}), 0) AS _n{pos}")
    return lost.selectExpr(*totals)


def orphan_rows(child: DataFrame, parent: DataFrame, ref: Ref) -> DataFrame:
    """Child rows of one reference that have no parent.

    First the distinct orphan *keys* are found, then the child is semi-joined to
    them.  Orphan keys are normally few, so the runtime-size-checked broadcast of
    adaptive execution keeps the wide child rows in place; when they are many the
    join falls back to a shuffled one that splits skewed partitions.
    """
    names = [f"_k{i}" for i in range(len(ref.columns))]
    whole = complete(ref.columns)
    keys = child.filter(whole).selectExpr(*renamed(ref.columns, names)).distinct()
    lost = without_parent(keys, names, parent, ref.parent_columns)
    found = child.join(lost, all_equal(ref.columns, names), "left_semi")
    if ref.null_is_orphan:
        found = found.unionByName(child.filter(f"NOT {whole}"))
    return found


def unmatched_keys(source: DataFrame, keys: Sequence[str], target: DataFrame, target_keys: Sequence[str]) -> DataFrame:
    """Distinct source keys missing in the target."""
    distinct = source.select(*keys).distinct()
    return without_parent(distinct, keys, target, target_keys)


def unmatched_summary(source: DataFrame, keys: Sequence[str], target: DataFrame, target_keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``missing`` and ``src_count`` distinct keys, from one pass over each side: one row, or one for each value of ``by``."""
    aliases = [f"_p{i}" for i in range(len(target_keys))]
    known = target.selectExpr(*renamed(target_keys, aliases), "true AS _hit").distinct()
    joined = source.select(*keys).distinct().join(known, all_equal(keys, aliases), "left")
    return joined.groupBy(*by).agg(F.expr("count_if(_hit IS NULL) AS missing"), F.expr("count(1) AS src_count"))


def unmatched_row_total(target: DataFrame, keys: Sequence[str], source: DataFrame, source_keys: Sequence[str]) -> DataFrame:
    """One row: ``rows`` of the target whose key the source does not know."""
    counted = group_sizes(target, keys, "_n")
    return without_parent(counted, keys, source, source_keys).selectExpr("coalesce(sum(_n), 0) AS rows")
