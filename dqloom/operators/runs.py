"""Evaluation of checks for many runs at once.

The run is a grouping key of every branch of the fused evaluation, so any number of runs costs one pass per table and
key, not one per run.  Tables hold the rows of many runs, told apart by a run column; where checks name that column in
their own keys and references it is the same column, so suites of versioned and of un-versioned tables both work.
Duplicates, references and source comparisons never look across runs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.operators import checks as C
from dqloom.operators import fusion
from dqloom.operators import keys as K
from dqloom.operators.checks import Check
from dqloom.operators.fusion import Placed, Tables
from dqloom.session import cut_lineage

RUN = "run_id"


def of_runs(rows: DataFrame, runs: DataFrame, run: str = RUN) -> DataFrame:
    """The rows of the given runs; where the run is a partition column, other runs' files stay unread."""
    return rows.join(runs.select(run).distinct(), run, "left_semi")


def _within(columns: Sequence[str], run: str) -> tuple[str, ...]:
    """Key columns with the run in front, once."""
    return (run, *(c for c in columns if c != run))


def _melt(grouped: DataFrame, run: str, counters: Mapping[int, str]) -> DataFrame:
    cells = [f"named_struct('pos', {pos}, 'rows_failed', cast({counter} AS BIGINT))" for pos, counter in counters.items()]
    return grouped.selectExpr(f"{run} AS {RUN}", f"inline(array({', '.join(cells)}))")


def _row_rules(table: DataFrame, run: str, members: Sequence[tuple[int, Check]]) -> DataFrame:
    # A run starts with one violation of each emptiness check; having any row takes it back.
    counters = {pos: f"count_if({c.rule})" if c.count == C.ROWS else "-1" for pos, c in members}
    counted = table.groupBy(run).agg(*[F.expr(f"{counter} AS _c{pos}") for pos, counter in counters.items()], F.expr("count(1) AS _rows"))
    return _melt(counted, run, {pos: f"_c{pos}" for pos in counters})


def _duplicates(table: DataFrame, run: str, keys: Sequence[str], members: Sequence[tuple[int, Check]]) -> DataFrame:
    keys = _within(keys, run)
    whole = K.complete(keys[1:]) if len(keys) > 1 else "true"
    kept = table if any(c.count_null_keys for _, c in members) else table.filter(whole)
    kept = kept.select(*keys)
    if all(c.wide for _, c in members):
        kept = K.repeated_by_digest(kept, keys)
    repeated = K.group_sizes(kept, keys).filter("cnt > 1")
    counters = {pos: "true" if c.count_null_keys else whole for pos, c in members}
    counted = repeated.groupBy(run).agg(*[F.expr(f"count_if({rule}) AS _c{pos}") for pos, rule in counters.items()])
    return _melt(counted, run, {pos: f"_c{pos}" for pos in counters})


def _references(child: DataFrame, parent: DataFrame, run: str, members: Sequence[tuple[int, C.Ref]]) -> DataFrame:
    def keyed(ref: C.Ref) -> C.Ref:
        own = [(c, p) for c, p in zip(ref.columns, ref.parent_columns, strict=True) if c != run]
        return replace(ref, columns=(run, *(c for c, _ in own)), parent_columns=(run, *(p for _, p in own)))

    refs = list(dict.fromkeys(ref for _, ref in members))
    by_run = [keyed(ref) for ref in refs]
    counted = K.reference_counts(child, by_run)
    names = [c for c in counted.columns if c.startswith("_k")]
    lost = K.without_parent(counted, names, parent, by_run[0].parent_columns)
    totals = []
    for pos, ref in enumerate(refs):
        rows = f"_n{pos}" if ref.null_is_orphan else f"CASE WHEN {K.complete(names)} THEN _n{pos} END"
        totals.append(F.expr(f"coalesce(sum({rows}), 0) AS _n{pos}"))
    per_run = lost.groupBy("_k0").agg(*totals)
    # a check may have several references to one parent; several checks may share a reference
    terms = defaultdict(list)
    for pos, ref in members:
        terms[pos].append(f"_n{refs.index(ref)}")
    return _melt(per_run, "_k0", {pos: " + ".join(names) for pos, names in terms.items()})


def _unmatched(pos: int, check: Check, tables: Tables, run: str) -> DataFrame:
    keys, other_keys = _within(check.keys, run), _within(check.other_keys, run)
    table, other = tables[check.table], tables[check.other]
    if check.count == C.UNMATCHED_KEYS:
        found = K.unmatched_summary(table, keys, other, other_keys, (run,))
        return found.selectExpr(f"{run} AS {RUN}", f"{pos} AS pos", "missing AS rows_failed", f"src_count AS {fusion.WHOLE}")
    lost = K.without_parent(K.group_sizes(table, keys, "_n"), keys, other, other_keys).groupBy(run).agg(F.expr("sum(_n) AS n"))
    return _melt(lost, run, {pos: "n"})


def violation_counts(checks: Sequence[Check], tables: Tables, runs: DataFrame, run: str = RUN) -> DataFrame:
    """``run_id, pos, rows_failed``: one row for every run of ``runs`` and every check, also where a run has no rows."""
    own: dict[str, DataFrame] = {}

    def rows_of(name: str) -> DataFrame:
        if name not in own:
            own[name] = of_runs(tables[name], runs, run)
        return own[name]

    mine = {name: rows_of(name) for c in checks for name in c.tables()}
    rows, groups, refs = defaultdict(list), defaultdict(list), defaultdict(list)
    parts = []
    for pos, check in enumerate(checks):
        if check.count in (C.ROWS, C.EMPTY):
            rows[check.table].append((pos, check))
        elif check.count == C.GROUPS:
            groups[check.table, check.keys].append((pos, check))
        elif check.count == C.ORPHANS:
            for ref in check.refs:
                refs[check.table, ref.parent, ref.parent_columns].append((pos, ref))
        else:
            parts.append(_unmatched(pos, check, mine, run))
    parts += [_row_rules(mine[t], run, members) for t, members in rows.items()]
    parts += [_duplicates(mine[t], run, keys, members) for (t, keys), members in groups.items()]
    parts += [_references(mine[t], mine[p], run, members) for (t, p, _), members in refs.items()]
    start = ", ".join(f"named_struct('pos', {pos}, 'rows_failed', {int(c.count == C.EMPTY)}L)" for pos, c in enumerate(checks))
    parts.append(runs.selectExpr(f"{run} AS {RUN}").distinct().selectExpr(RUN, f"inline(array({start}))"))
    united = reduce(fusion.united_counts, parts)
    whole = [F.max(fusion.WHOLE).alias(fusion.WHOLE)] if fusion.WHOLE in united.columns else []
    return united.groupBy(RUN, "pos").agg(F.sum("rows_failed").alias("rows_failed"), *whole)


def _broken(runs: DataFrame, run: str, placed: Placed, reason: str) -> DataFrame:
    columns = fusion.broken_columns(placed, reason)
    return runs.selectExpr(f"{run} AS {RUN}").distinct().selectExpr(RUN, *columns)


def evaluate(placed: Sequence[Placed], tables: Tables, runs: DataFrame, run: str = RUN) -> DataFrame:
    """Lazy result frame (``run_id`` and ``fusion.RESULT_COLUMNS``): every check for every run of ``runs``.

    A check that cannot be planned is reported as ERROR for every run and takes no other down.
    """
    if not placed:
        raise ValueError("no checks to evaluate")
    names = set(tables)
    usable = [p for p in placed if p.check.tables() <= names]
    broken = [(p, f"no table {sorted(p.check.tables() - names)}") for p in placed if p not in usable]
    try:
        parts = [fusion.described(usable, violation_counts([p.check for p in usable], tables, runs, run), (RUN,))] if usable else []
    except AnalysisException:
        sound = []
        for p in usable:
            try:
                violation_counts([p.check], tables, runs, run)
                sound.append(p)
            except AnalysisException as error:
                broken.append((p, str(error).strip()))
        parts = [fusion.described(sound, violation_counts([p.check for p in sound], tables, runs, run), (RUN,))] if sound else []
    return reduce(DataFrame.unionByName, [*parts, *(_broken(runs, run, p, reason) for p, reason in broken)])


def evaluated(placed: Sequence[Placed], tables: Tables, runs: DataFrame, run: str = RUN) -> DataFrame:
    """``evaluate``, carried out and stored in the shared folder: a few jobs, however many runs there are.

    If the job dies of the data, each check is tried alone, and a check that dies alone is tried run by run, so that
    only the runs whose values it cannot bear get an ERROR.
    """
    try:
        return cut_lineage(evaluate(placed, tables, runs, run))
    except PySparkException as error:
        if not fusion.of_data(error):
            raise
        if len(placed) > 1:
            return reduce(DataFrame.unionByName, [evaluated([p], tables, runs, run) for p in placed])
        known = [r[0] for r in runs.select(run).distinct().limit(2).collect()]
        if len(known) > 1:
            # one row per run to validate
            every = [r[0] for r in runs.select(run).distinct().collect()]
            return reduce(DataFrame.unionByName, [evaluated(placed, tables, runs.filter(F.col(run) == one), run) for one in every])
        return _broken(runs, run, placed[0], str(error).strip())


def row_counts(tables: Mapping[str, DataFrame], runs: DataFrame, run: str = RUN) -> DataFrame:
    """``run_id, table, rows`` for every run and table, zero where a run has none."""
    names = ", ".join(f"named_struct('table', '{name}', 'rows', 0L)" for name in tables)
    parts = [runs.selectExpr(f"{run} AS {RUN}").distinct().selectExpr(RUN, f"inline(array({names}))")]
    for name, rows in tables.items():
        parts.append(of_runs(rows, runs, run).groupBy(run).agg(F.expr("count(1) AS rows")).selectExpr(f"{run} AS {RUN}", f"'{name}' AS table", "rows"))
    return reduce(DataFrame.unionByName, parts).groupBy(RUN, "table").agg(F.sum("rows").alias("rows"))
