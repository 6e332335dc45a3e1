"""Evaluation of many checks with few scans.

Checks are fused by what they need, not run one query each:

* every row rule and emptiness check of a table becomes one column of a single
  aggregate (one column-pruned scan, no shuffle but the final one-row merge);
* duplicate checks on the same table and key share one ``groupBy``;
* references to the same parent share one child scan and one join.

The branches are united into one DataFrame, so Spark schedules them together and
one action evaluates the whole suite.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.functions.rules import quoted
from dqloom.operators import checks as C
from dqloom.operators import keys as K
from dqloom.operators.checks import Check

Tables = Mapping[str, DataFrame]

RESULT_COLUMNS = ("suite", "stage", "check_name", "rule_group", "severity", "status", "rows_failed", "message")
NOT_EVALUATED = -1
# Column of counts that are a part of something, as missing keys are of all keys: how many there are in all.
WHOLE = "of_all"


def _melt(one_row: DataFrame, counters: Mapping[int, str]) -> DataFrame:
    """One aggregate row -> one row per counter: ``pos, rows_failed``.

    Plans are assembled as SQL text here: a suite has dozens of expressions, and
    one call with text is far cheaper than building each of them call by call.
    """
    cells = [f"named_struct('pos', {pos}, 'rows_failed', cast({counter} AS BIGINT))" for pos, counter in counters.items()]
    return one_row.selectExpr(f"inline(array({', '.join(cells)}))")


def _row_rules(table: DataFrame, members: Sequence[tuple[int, Check]]) -> DataFrame:
    aggregates = []
    for pos, check in members:
        counter = f"count_if({check.rule})" if check.count == C.ROWS else "CASE WHEN count(1) = 0 THEN 1 ELSE 0 END"
        aggregates.append(f"{counter} AS _c{pos}")
    return _melt(table.selectExpr(*aggregates), {pos: f"_c{pos}" for pos, _ in members})


def _duplicate_rules(table: DataFrame, keys: Sequence[str], members: Sequence[tuple[int, Check]]) -> DataFrame:
    whole = K.complete(keys)
    # Rows that no member can count are dropped before the shuffle.
    kept = table if any(c.count_null_keys for _, c in members) else table.filter(whole)
    aggregates = [
        f"count_if(cnt > 1{'' if check.count_null_keys else f' AND {whole}'}) AS _c{pos}" for pos, check in members
    ]
    kept = kept.select(*keys)
    if all(c.wide for _, c in members):
        kept = K.repeated_by_digest(kept, keys)
    return _melt(K.group_sizes(kept, keys).selectExpr(*aggregates), {pos: f"_c{pos}" for pos, _ in members})


def _reference_rules(child: DataFrame, parent: DataFrame, members: Sequence[tuple[int, C.Ref]]) -> DataFrame:
    refs = list(dict.fromkeys(ref for _, ref in members))
    # a check may have several references to one parent; several checks may share a reference
    terms = defaultdict(list)
    for pos, ref in members:
        terms[pos].append(f"_n{refs.index(ref)}")
    return _melt(K.orphan_totals(child, parent, refs), {pos: " + ".join(names) for pos, names in terms.items()})


def _branches(checks: Sequence[tuple[int, Check]], tables: Tables) -> list[DataFrame]:
    rows, groups, refs = defaultdict(list), defaultdict(list), defaultdict(list)
    out = []
    for pos, check in checks:
        if check.count in (C.ROWS, C.EMPTY):
            rows[check.table].append((pos, check))
        elif check.count == C.GROUPS:
            groups[check.table, check.keys].append((pos, check))
        elif check.count == C.ORPHANS:
            for ref in check.refs:
                refs[check.table, ref.parent, ref.parent_columns].append((pos, ref))
        elif check.count == C.UNMATCHED_KEYS:
            found = K.unmatched_summary(tables[check.table], check.keys, tables[check.other], check.other_keys)
            out.append(found.selectExpr(f"{pos} AS pos", "missing AS rows_failed", f"src_count AS {WHOLE}"))
        else:
            found = K.unmatched_row_total(tables[check.table], check.keys, tables[check.other], check.other_keys)
            out.append(_melt(found, {pos: "rows"}))
    out += [_row_rules(tables[t], members) for t, members in rows.items()]
    out += [_duplicate_rules(tables[t], keys, members) for (t, keys), members in groups.items()]
    out += [_reference_rules(tables[t], tables[p], members) for (t, p, _), members in refs.items()]
    return out


def violation_counts(checks: Sequence[Check], tables: Tables) -> DataFrame:
    """``pos, rows_failed`` for every check, in one DataFrame; ``of_all`` where a check counts a part of something.

    A check with several references appears once per parent table; the counts
    are summed here (over at most a few dozen rows).
    """
    united = reduce(united_counts, _branches(list(enumerate(checks)), tables))
    if any(len({(r.parent, r.parent_columns) for r in c.refs}) > 1 for c in checks):
        whole = [F.max(WHOLE).alias(WHOLE)] if WHOLE in united.columns else []
        united = united.groupBy("pos").agg(F.sum("rows_failed").alias("rows_failed"), *whole)
    return united


def united_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def status_of(rows_failed: str = "rows_failed", severity: str = "severity") -> str:
    return (
        f"CASE WHEN {rows_failed} = {NOT_EVALUATED} THEN '{C.BROKEN}' WHEN {rows_failed} = 0 THEN '{C.PASS}' "
        f"WHEN {severity} = '{C.WARNING}' THEN '{C.WARN}' ELSE '{C.FAIL}' END"
    )


@dataclass(frozen=True)
class Placed:
    """A check as part of a suite at a stage."""

    suite: str
    stage: str
    check: Check


def described(placed: Sequence[Placed], counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Attach the declared metadata, which travels as literals indexed by position; ``keep`` names further columns."""
    meta = ", ".join(
        f"named_struct('suite', {quoted(p.suite)}, 'stage', {quoted(p.stage)}, 'name', {quoted(p.check.name)}, "
        f"'grp', {quoted(p.check.group)}, 'sev', {quoted(p.check.severity)})"
        for p in placed
    )
    whole = WHOLE if WHOLE in counts.columns else "cast(NULL AS BIGINT)"
    return counts.selectExpr(*keep, f"array({meta})[pos] AS m", "rows_failed", f"{whole} AS _whole").selectExpr(
        *keep,
        "m.suite AS suite",
        "m.stage AS stage",
        "m.name AS check_name",
        "m.grp AS rule_group",
        "m.sev AS severity",
        f"{status_of(severity='m.sev')} AS status",
        "rows_failed",
        "CASE WHEN rows_failed > 0 THEN concat(rows_failed, ' missing of ', _whole) END AS message",
    )


def broken_columns(placed: Placed, reason: str) -> list[str]:
    """The result columns of a check that could not run."""
    c = placed.check
    values = [placed.suite, placed.stage, c.name, c.group, c.severity, C.BROKEN, str(NOT_EVALUATED), reason]
    return [f"cast({quoted(v)} AS {'BIGINT' if n == 'rows_failed' else 'STRING'}) AS {n}" for v, n in zip(values, RESULT_COLUMNS)]


def _broken(spark: SparkSession, placed: Placed, reason: str) -> DataFrame:
    return spark.range(1).selectExpr(*broken_columns(placed, reason))


def _reason(error: Exception) -> str:
    return str(error).strip()


def of_data(error: PySparkException) -> bool:
    """True for errors that a value causes: SQLSTATE class 22 (data exception) and raise_error's P0001."""
    state = error.getSqlState() or ""
    return state.startswith("22") or state == "P0001"


def evaluate_placed(placed: Sequence[Placed], tables: Tables, spark: SparkSession | None = None) -> DataFrame:
    """Lazy result frame (``RESULT_COLUMNS``) of checks from any number of suites and stages.

    Fusion works across suites: the more of them look at the same tables, the
    less each one costs.  A check that cannot be planned (unknown table or column)
    is reported with status ERROR and counts as failed; it does not take the
    others down.
    """
    if not placed:
        raise ValueError("no checks to evaluate")
    names = set(tables)
    spark = spark or tables[next(iter(tables))].sparkSession
    usable = [p for p in placed if p.check.tables() <= names]
    broken = [(p, f"no table {sorted(p.check.tables() - names)}") for p in placed if p not in usable]
    try:
        parts = [described(usable, violation_counts([p.check for p in usable], tables))] if usable else []
    except AnalysisException:
        sound = []
        for p in usable:
            try:
                violation_counts([p.check], tables)
                sound.append(p)
            except AnalysisException as error:
                broken.append((p, _reason(error)))
        parts = [described(sound, violation_counts([p.check for p in sound], tables))] if sound else []
    parts += [_broken(spark, p, reason) for p, reason in broken]
    return reduce(DataFrame.unionByName, parts)


def evaluate(suite: str, stage: str, checks: Sequence[Check], tables: Tables) -> DataFrame:
    """Lazy result frame of one suite at one stage."""
    return evaluate_placed([Placed(suite, stage, c) for c in checks], tables)


def collect_results(suite: str, stage: str, checks: Sequence[Check], tables: Tables) -> list[dict]:
    """Run the checks and return one dict per check.

    The result has one row per declared check, so collecting it is bounded by the
    suite.  If the fused job dies of the data (for instance on a value a custom
    rule casts strictly) each check is retried alone to find the broken ones; any
    other failure, a lost cluster say, is raised.
    """
    try:
        return [r.asDict() for r in evaluate(suite, stage, checks, tables).collect()]
    except PySparkException as whole:
        if not of_data(whole):
            raise
        spark = tables[next(iter(tables))].sparkSession
        results = []
        for check in checks:
            try:
                results += [r.asDict() for r in evaluate(suite, stage, [check], tables).collect()]
            except PySparkException as error:
                if not of_data(error):
                    raise
                results += [r.asDict() for r in _broken(spark, Placed(suite, stage, check), _reason(error)).collect()]
        return results


def tally(results: DataFrame) -> DataFrame:
    """Totals per suite and stage; a check that could not run counts as failed."""
    failed = F.col("status").isin(C.FAIL, C.BROKEN)
    return results.groupBy("suite", "stage").agg(
        F.count(F.lit(1)).alias("checks_total"),
        F.count_if(failed).alias("checks_failed"),
        F.when(F.count_if(failed) == 0, "SUCCESS").otherwise("FAILED").alias("status"),
    )


def failing_rows(check: Check, tables: Tables) -> DataFrame:
    """The violating rows themselves (the fail-rows form of a check)."""
    table = tables[check.table]
    shown = [F.col(c) for c in check.show] if check.show else [F.col(c) for c in table.columns]
    if check.count == C.ROWS:
        return table.filter(check.rule).select(*shown)
    if check.count == C.GROUPS:
        return K.duplicated(table, check.keys, check.count_null_keys, check.wide)
    if check.count == C.ORPHANS:
        parts = [
            K.orphan_rows(table, tables[ref.parent], ref).select(F.lit(ref.label).alias("ref_type"), *shown) for ref in check.refs
        ]
        return reduce(DataFrame.unionByName, parts)
    if check.count == C.EMPTY:
        return table.selectExpr("count(1) AS rows").filter("rows = 0")
    if check.count == C.UNMATCHED_KEYS:
        return K.unmatched_keys(table, check.keys, tables[check.other], check.other_keys)
    names = [f"_k{i}" for i in range(len(check.keys))]
    distinct = table.selectExpr(*K.renamed(check.keys, names)).distinct()
    lost = K.without_parent(distinct, names, tables[check.other], check.other_keys)
    return table.join(lost, K.all_equal(check.keys, names, "<=>"), "left_semi").select(*shown)


def drill_down(check: Check, tables: Tables, order: Sequence[str], limit: int = 20) -> DataFrame:
    """The first few violating rows in a stable order, for a report."""
    return failing_rows(check, tables).orderBy(*order).limit(limit)


def split_by_constraints(table: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Every row with the names of the row rules it breaks (``violations``, empty when good).

    Filtering on the array size separates the accepted rows from the quarantine.
    """
    broken = [F.when(F.expr(c.rule), F.lit(c.name)) for c in checks if c.count == C.ROWS]
    return table.withColumn("violations", F.filter(F.array(*broken), lambda name: name.isNotNull()))
