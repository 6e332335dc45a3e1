"""Check declarations.

A check names a table and states how to count violations.  It is plain data;
``operators.fusion`` turns a list of checks into DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

# Severities, outcome words and rule groups.
ERROR, WARNING = "error", "warning"
PASS, WARN, FAIL, BROKEN, SKIP = "PASS", "WARN", "FAIL", "ERROR", "SKIP"
SCHEMA_MISMATCH = "schema_mismatch"
MISSING_VALUES = "missing_values"
OUT_OF_RANGE = "out_of_range"
DUPLICATES = "duplicate_records"
REFERENTIAL = "referential_integrity_violation"
CORRUPTION = "data_corruption"
CONSTRAINT = "sql_constraint"

# How violations are counted.
ROWS, GROUPS, ORPHANS, EMPTY, UNMATCHED_KEYS, UNMATCHED_ROWS = (
    "rows",
    "groups",
    "orphans",
    "empty",
    "unmatched_keys",
    "unmatched_rows",
)


@dataclass(frozen=True)
class Ref:
    """A foreign key: child columns -> parent columns.

    ``null_is_orphan`` decides whether an incomplete child key counts.
    """

    label: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    null_is_orphan: bool = False


@dataclass(frozen=True)
class Check:
    name: str
    table: str
    count: str
    rule: str | None = None
    keys: tuple[str, ...] = ()
    count_null_keys: bool = True
    refs: tuple[Ref, ...] = ()
    other: str | None = None
    other_keys: tuple[str, ...] = ()
    group: str = ""
    severity: str = ERROR
    show: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    wide: bool = False

    def tables(self) -> set[str]:
        names = {self.table} | {r.parent for r in self.refs}
        return names | ({self.other} if self.other else set())

    def warning(self) -> Check:
        return replace(self, severity=WARNING)

    def tagged(self, *tags: str) -> Check:
        return replace(self, tags=self.tags + tags)

    def grouped(self, group: str) -> Check:
        return replace(self, group=group)


def rows_where(name: str, table: str, rule: str, group: str = CORRUPTION, show: tuple[str, ...] = ()) -> Check:
    """Rows for which ``rule`` is true."""
    return Check(name, table, ROWS, rule=rule, group=group, show=show)


def duplicate_groups(name: str, table: str, *keys: str, count_null_keys: bool = True, wide: bool = False) -> Check:
    """Key values held by more than one row.

    ``count_null_keys=False`` ignores rows with an incomplete key; otherwise the
    NULLs form a group of their own.  ``wide`` is for long values such as texts:
    only rows whose digest repeats are shuffled by value.
    """
    return Check(name, table, GROUPS, keys=keys, count_null_keys=count_null_keys, group=DUPLICATES, wide=wide)


def orphans(name: str, table: str, *refs: Ref, show: tuple[str, ...] = ()) -> Check:
    """Rows whose reference has no parent, summed over the references."""
    return Check(name, table, ORPHANS, refs=refs, group=REFERENTIAL, show=show)


def not_empty(name: str, table: str) -> Check:
    """One violation when the table has no rows."""
    return Check(name, table, EMPTY, group=MISSING_VALUES)


def all_loaded(name: str, source: str, source_keys: tuple[str, ...], target: str, target_keys: tuple[str, ...]) -> Check:
    """Distinct source keys that never reached the target."""
    return Check(
        name, source, UNMATCHED_KEYS, keys=source_keys, other=target, other_keys=target_keys, group="source_completeness"
    )


def none_invented(name: str, target: str, target_keys: tuple[str, ...], source: str, source_keys: tuple[str, ...]) -> Check:
    """Target rows whose key is unknown to the source."""
    return Check(
        name, target, UNMATCHED_ROWS, keys=target_keys, other=source, other_keys=source_keys, group="source_exclusivity"
    )


def configured(checks: Iterable[Check], config: Mapping[str, Mapping]) -> tuple[Check, ...]:
    """Checks with per-check settings applied: ``{name: {enabled, severity}}``; unnamed checks stay as declared."""
    out = []
    for check in checks:
        settings = config.get(check.name, {})
        if settings.get("enabled", True):
            out.append(replace(check, severity=str(settings.get("severity", check.severity)).lower()))
    return tuple(out)


@dataclass(frozen=True)
class Suite:
    """Named checks per stage."""

    name: str
    stages: dict[str, tuple[Check, ...]]

    def checks(self, stage: str) -> tuple[Check, ...]:
        return self.stages.get(stage, ())

    def select(self, tag: str) -> tuple[Check, ...]:
        return tuple(c for checks in self.stages.values() for c in checks if tag in c.tags)

    def all(self) -> tuple[Check, ...]:
        return tuple(c for checks in self.stages.values() for c in checks)
