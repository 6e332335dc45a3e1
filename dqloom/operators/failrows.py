"""The violating rows of whole suites, and quarantine by all kinds of checks.

Every table is scanned once to tag its rows with the checks they break.  What a row cannot know by itself is joined to
it: the keys that repeat, found first by an aggregate that counts a hot key on the map side, and the keys of its parents,
which are normally small tables, so that the rows stay where they are.  Whether such a join is broadcast or shuffled is
left to Spark's size checks; the rows are its outer side, so adaptive execution can split a hot key's rows among tasks in
either case.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqloom.operators import checks as C
from dqloom.operators import keys as K
from dqloom.operators.checks import Check
from dqloom.operators.fusion import Tables

# A row's broken checks; ``detail`` names the reference of a check that has several.
VIOLATIONS = "violations"
ENTRY = "array<struct<check_name: string, detail: string>>"
SAMPLE_ROWS = 20


class _Rows:
    """A table on the way to its tags: rows with one flag per set of keys."""

    def __init__(self, rows: DataFrame):
        self.rows, self.flags = rows, {}

    def hit(self, key: tuple, columns: Sequence[str], given, null_safe: bool) -> Column:
        """True for rows whose ``columns`` are among the keys that ``given()`` gives (distinct, columns ``_k0`` and on)."""
        if key not in self.flags:
            n = len(self.flags)
            names = [f"_b{n}_{i}" for i in range(len(columns))]
            found = given().selectExpr(*[f"_k{i} AS {name}" for i, name in enumerate(names)], f"true AS _hit{n}")
            equal = K.all_equal([f"`{c}`" for c in columns], names, "<=>" if null_safe else "=")
            self.rows = self.rows.join(found, equal, "left").drop(*names)
            self.flags[key] = f"_hit{n}"
        return F.coalesce(F.col(self.flags[key]), F.lit(False))


def _repeated(table: DataFrame, check: Check) -> DataFrame:
    found = K.duplicated(table, check.keys, check.count_null_keys, check.wide)
    return found.selectExpr(*K.renamed(check.keys, [f"_k{i}" for i in range(len(check.keys))]))


def _known(parent: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct keys of a parent."""
    names = [f"_k{i}" for i in range(len(columns))]
    return parent.selectExpr(*K.renamed(columns, names)).filter(K.complete(names)).distinct()


def tagged(name: str, checks: Sequence[Check], tables: Tables) -> DataFrame:
    """Every row of a table with ``violations``: the checks of that table it breaks, in their order, empty when good.

    All rows of a repeated key break a duplicate check; an incomplete key counts where the check says so.  A row breaks
    a check once per reference.  Emptiness is nothing that a row could break.
    """
    own = [c for c in checks if c.table == name]
    table = tables[name]
    state, marks = _Rows(table), []
    for check in own:
        if check.count == C.ROWS:
            marks.append((F.expr(check.rule), check.name, None))
        elif check.count == C.GROUPS:
            hit = state.hit(("groups", check.keys, check.wide, check.count_null_keys), check.keys, lambda c=check: _repeated(table, c), True)
            marks.append((hit, check.name, None))
        elif check.count == C.ORPHANS:
            for ref in check.refs:
                known = state.hit(
                    ("refs", ref.columns, ref.parent, ref.parent_columns), ref.columns, lambda r=ref: _known(tables[r.parent], r.parent_columns), False
                )
                # an incomplete key has no parent
                lost = ~known if ref.null_is_orphan else ~known & F.expr(K.complete(ref.columns))
                marks.append((lost, check.name, ref.label))
        elif check.count in (C.UNMATCHED_KEYS, C.UNMATCHED_ROWS):

            def unmatched(c=check) -> DataFrame:
                keys = K.unmatched_keys(table, c.keys, tables[c.other], c.other_keys)
                return keys.selectExpr(*K.renamed(c.keys, [f"_k{i}" for i in range(len(c.keys))]))

            marks.append((state.hit(("other", check.keys, check.other, check.other_keys), check.keys, unmatched, True), check.name, None))
    if not marks:
        return table.withColumn(VIOLATIONS, F.array().cast(ENTRY))
    entries = [
        F.when(hit, F.struct(F.lit(check).alias("check_name"), F.lit(detail).cast("string").alias("detail"))) for hit, check, detail in marks
    ]
    violations = F.filter(F.array(*entries), lambda entry: entry.isNotNull())
    return state.rows.select(*(state.rows[f"`{c}`"] for c in table.columns), violations.cast(ENTRY).alias(VIOLATIONS))


def split(name: str, checks: Sequence[Check], tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The accepted rows of a table and its quarantine, which keeps the ``violations``."""
    rows = tagged(name, checks, tables)
    bad = F.size(VIOLATIONS) > 0
    return rows.filter(~bad).drop(VIOLATIONS), rows.filter(bad)


def _row_key(columns: Sequence[str]) -> str:
    shown = ", ".join(f"coalesce(cast(`{c}` AS STRING), 'NULL')" for c in columns)
    return f"concat_ws('|', {shown})"


def quarantine(checks: Sequence[Check], tables: Tables, shown: Mapping[str, Sequence[str]]) -> DataFrame:
    """``table, row_key, violations`` of all bad rows of all tables; check names joined by a comma, each once.

    ``shown`` names the columns that tell a table's rows apart for the reader (all where it names none).
    """
    parts = []
    for name in dict.fromkeys(c.table for c in checks):
        _, bad = split(name, checks, tables)
        key = _row_key(shown.get(name) or tables[name].columns)
        names = f"array_join(array_distinct(transform({VIOLATIONS}, v -> v.check_name)), ',') AS {VIOLATIONS}"
        parts.append(bad.selectExpr(f"'{name}' AS table", f"{key} AS row_key", names))
    return reduce(DataFrame.unionByName, parts)


def fail_rows(checks: Sequence[Check], tables: Tables, shown: Mapping[str, Sequence[str]]) -> DataFrame:
    """``check_name, detail, table, row_key``: one row per violating row, check and reference of a whole suite.

    An empty table that should have rows is shown as one row without a key.
    """
    parts = []
    for name in dict.fromkeys(c.table for c in checks):
        key = _row_key(shown.get(name) or tables[name].columns)
        bad = tagged(name, checks, tables).selectExpr(f"'{name}' AS table", f"{key} AS row_key", f"inline({VIOLATIONS})")
        parts.append(bad.select("check_name", "detail", "table", "row_key"))
        empty = [c.name for c in checks if c.table == name and c.count == C.EMPTY]
        if empty:
            rows = ", ".join(f"named_struct('check_name', '{c}', 'detail', cast(NULL AS STRING), 'table', '{name}', 'row_key', cast(NULL AS STRING))" for c in empty)
            parts.append(tables[name].selectExpr("count(1) AS n").filter("n = 0").selectExpr(f"inline(array({rows}))"))
    return reduce(DataFrame.unionByName, parts)


def samples(rows: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``limit`` fail-rows of each check, by row key, numbered by ``rank``.

    Spark keeps the first rows of each check in every task before they are shuffled, so a check that all rows break
    sends ``limit`` rows a task; that holds for limits within spark.sql.optimizer.windowGroupLimitThreshold.
    """
    order = Window.partitionBy("check_name").orderBy("row_key", "detail", "table")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
