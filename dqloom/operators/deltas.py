"""Check results of many versions of the tables from one pass over the base and the rows that differ.

A version is the base with a few rows taken out and a few put in.  Its counts follow from the base's:

* violating rows: those among the rows that came, less those among the rows that went;
* repeated keys: only the keys of such rows can change sides, so the base counts of those keys are enough;
* references: the rows that came and went are looked up, and where a parent key appears or disappears, the base's rows
  with that key change sides;
* emptiness: the number of rows.

All versions are handled together, with the version as a grouping key.  A version that differs everywhere, in some
columns or in all, is evaluated as a whole, but only for the checks that read what differs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.operators import checks as C
from dqloom.operators import fusion
from dqloom.operators import keys as K
from dqloom.operators import mutations as M
from dqloom.operators.checks import Check
from dqloom.operators.fusion import Placed, Tables
from dqloom.session import cut_lineage

VERSION = "version"


@dataclass(frozen=True)
class Change:
    """How a version of a table differs: rows that go and come, or all rows, in ``columns`` (none: in all of them)."""

    gone: DataFrame | None = None
    come: DataFrame | None = None
    whole: DataFrame | None = None
    columns: tuple[str, ...] = ()


def _touched(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("_key"), F.col(key) == F.col("_key"), "left_semi")


def entity_change(tables: Tables, action: str, entity: str = "matches", n: int | None = None, seed: str | None = None) -> dict[str, Change]:
    """What a mutation of the un-versioned tables changes: the same as ``mutations.entity_mutation``.

    A mutation that changes the rows with the first keys does the same to those rows alone.
    """
    change = M.entity_mutation(action, entity, n, seed)
    matches = tables["matches"]
    if action in ("swap_teams", "collapse_teams", "matchday_out_of_range"):
        count = n or (M.MATCHDAY_COUNT if action == "matchday_out_of_range" else M.SWAP_COUNT)
        rows = _touched(matches, "id", M.picked(matches, "id", count, None if action == "matchday_out_of_range" else seed))
        return {"matches": Change(rows, change({**_plain(tables), "matches": rows})["matches"])}
    if action in ("drop_required", "corrupt_id", "dim_competition"):
        name = "competitions" if action == "dim_competition" else entity
        rows = tables[name].filter(F.col("id") == tables[name].agg(F.min("id")).scalar())
        return {name: Change(rows, change({**_plain(tables), name: rows})[name])}
    if action == "duplicate_first":
        return {entity: Change(come=M.first_row(tables[entity]))}
    if action == "fact_match":
        return {"matches": Change(come=M.planted_match(tables, M.ENTITY_LAYOUT))}
    if action == "fact_standing":
        return {"standings": Change(come=M.planted_standing(tables, M.ENTITY_LAYOUT))}
    columns = ("utcDate",) if action == "season_dates_missing" else ()
    return {name: Change(whole=rows, columns=columns) for name, rows in change(tables).items()}


def _plain(tables: Tables) -> dict[str, DataFrame]:
    return {name: tables[name] for name in tables}


def whole_changes(tables: Tables, changed: Mapping[str, DataFrame]) -> dict[str, Change]:
    """Changes of a version about which no more is known than its tables."""
    return {name: Change(whole=rows) for name, rows in changed.items() if rows is not tables[name]}


def reads(check: Check, table: str, columns: Sequence[str]) -> bool:
    """Whether a check looks at one of the columns of the table (none: at the table at all)."""
    if table not in check.tables():
        return False
    if not columns:
        return True
    own: set[str] = set()
    if check.table == table:
        own |= set(check.keys) | {c for r in check.refs for c in r.columns}
        own |= {c for c in columns if re.search(rf"\b{re.escape(c)}\b", check.rule or "")}
    own |= {c for r in check.refs if r.parent == table for c in r.parent_columns}
    if check.other == table:
        own |= set(check.other_keys)
    return bool(own & set(columns))


def _net(delta: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``version, <names>, _net``: by how many rows each key's count differs, where it does."""
    return delta.groupBy(VERSION, *[F.expr(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.sum("_sign").alias("_net")).filter("_net <> 0")


def _base_counts(table: DataFrame, keys: Sequence[str], net: DataFrame, names: Sequence[str], null_safe: bool) -> DataFrame:
    """``net`` with ``_base``: rows of the base per key.  Only rows with a touched key are counted."""
    wanted = net.select(*names).distinct()
    renamed = [f"_w{i}" for i in range(len(names))]
    operator = "<=>" if null_safe else "="
    touched = table.selectExpr(*K.renamed(keys, names)).join(
        wanted.toDF(*renamed), K.all_equal(names, renamed, operator), "left_semi"
    )
    counted = K.group_sizes(touched, names, "_base").toDF(*renamed, "_base")
    return net.join(counted, K.all_equal(names, renamed, operator), "left").select(*net.columns, F.coalesce("_base", F.lit(0)).alias("_base"))


def _melt(grouped: DataFrame, counters: Mapping[int, str]) -> DataFrame:
    cells = [f"named_struct('pos', {pos}, 'rows_failed', cast({counter} AS BIGINT))" for pos, counter in counters.items()]
    return grouped.selectExpr(VERSION, f"inline(array({', '.join(cells)}))")


def _row_rules(delta: DataFrame, members: Sequence[tuple[int, Check]]) -> DataFrame:
    sums = [F.expr(f"coalesce(sum(CASE WHEN {c.rule} THEN _sign END), 0) AS _c{pos}") for pos, c in members]
    return _melt(delta.groupBy(VERSION).agg(*sums), {pos: f"_c{pos}" for pos, _ in members})


def _emptiness(table: DataFrame, delta: DataFrame, members: Sequence[tuple[int, Check]]) -> DataFrame:
    base = table.agg(F.count(F.lit(1))).scalar()
    after = delta.groupBy(VERSION).agg(F.sum("_sign").alias("_net")).withColumn("_base", base)
    return _melt(after, {pos: "int(_base + _net = 0) - int(_base = 0)" for pos, _ in members})


def _repeats(table: DataFrame, delta: DataFrame, keys: Sequence[str], members: Sequence[tuple[int, Check]]) -> DataFrame:
    names = [f"_k{i}" for i in range(len(keys))]
    counted = _base_counts(table, keys, _net(delta, keys, names), names, True)
    sides = "int(_base + _net > 1) - int(_base > 1)"
    sums = [F.expr(f"coalesce(sum(CASE WHEN {'true' if c.count_null_keys else K.complete(names)} THEN {sides} END), 0) AS _c{pos}") for pos, c in members]
    return _melt(counted.groupBy(VERSION).agg(*sums), {pos: f"_c{pos}" for pos, _ in members})


def _references(tables: Tables, deltas: Mapping[str, DataFrame], child: str, parent: str, parent_columns: Sequence[str], members) -> list[DataFrame]:
    """Orphans that come or go, per check.  ``members``: (position, reference) with the same child and parent key."""
    names = [f"_k{i}" for i in range(len(parent_columns))]
    parts = []
    moved = None
    if parent in deltas:
        net = _net(deltas[parent].filter(K.complete(parent_columns)), parent_columns, names)
        counted = _base_counts(tables[parent], parent_columns, net, names, False)
        # parent keys that a version gains (1) or loses (-1)
        moved = counted.selectExpr(VERSION, *names, "int(_base + _net > 0) - int(_base > 0) AS _move").filter("_move <> 0")
    for pos, ref in members:
        if moved is not None:
            held = tables[child].filter(K.complete(ref.columns)).selectExpr(*K.renamed(ref.columns, [f"_c{i}" for i in range(len(names))]))
            hit = held.join(moved, K.all_equal([f"_c{i}" for i in range(len(names))], names))
            parts.append(_melt(hit.groupBy(VERSION).agg(F.sum(-F.col("_move")).alias("n")), {pos: "n"}))
        if child in deltas:
            rows = deltas[child].selectExpr(VERSION, "_sign", *K.renamed(ref.columns, names))
            aliases = [f"_p{i}" for i in range(len(names))]
            known = tables[parent].selectExpr(*K.renamed(parent_columns, aliases)).join(
                rows.select(*names).distinct(), K.all_equal(aliases, names), "left_semi"
            ).distinct().withColumn("_there", F.lit(1))
            found = rows.join(known, K.all_equal(names, aliases), "left").drop(*aliases)
            if moved is not None:
                there = moved.withColumnsRenamed({n: f"_m{i}" for i, n in enumerate(names)} | {VERSION: "_version"})
                same = K.all_equal([VERSION, *names], ["_version", *[f"_m{i}" for i in range(len(names))]])
                found = found.join(there, same, "left").withColumn("_there", F.coalesce("_there", F.lit(0)) + F.coalesce("_move", F.lit(0)))
            orphan = "coalesce(_there, 0) = 0" + ("" if ref.null_is_orphan else f" AND {K.complete(names)}")
            parts.append(_melt(found.groupBy(VERSION).agg(F.expr(f"coalesce(sum(CASE WHEN {orphan} THEN _sign END), 0) AS n")), {pos: "n"}))
    return parts


def _gathered(changes: Mapping[str, Mapping[str, Change]]) -> dict[str, DataFrame]:
    """``version, _sign`` and the columns of the table: the rows of all versions that came (1) and went (-1), stored once."""
    rows = defaultdict(list)
    for version, tables in changes.items():
        for name, change in tables.items():
            for sign, part in ((-1, change.gone), (1, change.come)):
                if part is not None:
                    rows[name].append(part.select(F.lit(version).alias(VERSION), F.lit(sign).cast("bigint").alias("_sign"), "*"))
    return {name: cut_lineage(reduce(DataFrame.unionByName, parts)) for name, parts in rows.items()}


def violation_counts(checks: Sequence[Check], tables: Tables, changes: Mapping[str, Mapping[str, Change]], base: str) -> DataFrame:
    """``version, pos, rows_failed`` of the base (named ``base``) and of every version."""
    deltas = _gathered(changes)
    placed = list(enumerate(checks))
    parts, whole = [], []
    for version, changed in changes.items():
        everywhere = {name: change for name, change in changed.items() if change.whole is not None}
        compared = any(c.count in (C.UNMATCHED_KEYS, C.UNMATCHED_ROWS) for c in checks)
        if not everywhere and not compared:
            continue
        version_tables = {**_plain(tables), **{n: change.whole for n, change in everywhere.items()}}
        for name, change in changed.items():
            if change.whole is None:
                own = deltas[name].filter(F.col(VERSION) == version)
                goes, comes = (own.filter(F.col("_sign") == s).drop(VERSION, "_sign") for s in (-1, 1))
                version_tables[name] = tables[name].exceptAll(goes).unionByName(comes)
        again = [
            (pos, c)
            for pos, c in placed
            if any(reads(c, n, change.columns) for n, change in everywhere.items())
            or (c.count in (C.UNMATCHED_KEYS, C.UNMATCHED_ROWS) and c.tables() & set(changed))
        ]
        if again:
            counted = fusion.violation_counts([c for _, c in again], version_tables)
            positions = ", ".join(str(pos) for pos, _ in again)
            parts.append(counted.selectExpr(f"'{version}' AS {VERSION}", f"array({positions})[pos] AS pos", "rows_failed"))
            whole += [(version, pos) for pos, _ in again]
    rows, groups, refs = defaultdict(list), defaultdict(list), defaultdict(list)
    maintained = []
    for pos, check in placed:
        if check.count in (C.ROWS, C.EMPTY) and check.table in deltas:
            rows[check.table, check.count].append((pos, check))
        elif check.count == C.GROUPS and check.table in deltas:
            groups[check.table, check.keys].append((pos, check))
        elif check.count == C.ORPHANS:
            for ref in check.refs:
                if check.table in deltas or ref.parent in deltas:
                    refs[check.table, ref.parent, ref.parent_columns].append((pos, ref))
    for (name, count), members in rows.items():
        maintained.append(_row_rules(deltas[name], members) if count == C.ROWS else _emptiness(tables[name], deltas[name], members))
    maintained += [_repeats(tables[n], deltas[n], keys, members) for (n, keys), members in groups.items()]
    for (child, parent, columns), members in refs.items():
        maintained += _references(tables, deltas, child, parent, columns, members)
    names = ", ".join(f"'{v}'" for v in (base, *changes))
    maintained.append(fusion.violation_counts(checks, tables).selectExpr(f"explode(array({names})) AS {VERSION}", "pos", "rows_failed"))
    counted = reduce(DataFrame.unionByName, maintained)
    if whole:
        # what was evaluated as a whole replaces what would follow from the base
        pairs = ", ".join(f"named_struct('v', '{v}', 'p', {pos})" for v, pos in whole)
        counted = counted.filter(f"NOT array_contains(array({pairs}), named_struct('v', {VERSION}, 'p', pos))")
    return reduce(DataFrame.unionByName, [counted, *parts]).groupBy(VERSION, "pos").agg(F.sum("rows_failed").alias("rows_failed"))


def evaluate(placed: Sequence[Placed], tables: Tables, changes: Mapping[str, Mapping[str, Change]], base: str) -> DataFrame:
    """Result frame (``version`` and ``fusion.RESULT_COLUMNS``) of the base and all versions.

    The rows that differ are stored when this is called; the rest is lazy.  ``tables`` should be cheap to read more
    than once: each table is read for the base's checks, and again only for the keys that a version touches.
    """
    return fusion.described(placed, violation_counts([p.check for p in placed], tables, changes, base), (VERSION,))
