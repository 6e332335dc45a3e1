"""Which suites run at which stage."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

# The stages, and the environment variable that overrides the repeat count.
STAGES = ("E", "T", "L")
REPEATS_OVERRIDE = "DQLOOM_REPEATS"


@dataclass(frozen=True)
class Strategy:
    """A tools plan: suites per stage, baseline runs and how often to repeat."""

    name: str
    by_stage: Mapping[str, Sequence[str]]
    repeats: int = 1
    include_experiments: bool = True
    only_unprocessed: bool = False
    baseline: Mapping[str, str] = field(default_factory=dict)

    def suites(self, stage: str) -> Sequence[str]:
        return tuple(self.by_stage.get(stage, ()))

    @property
    def runs(self) -> int:
        """Repeats of a measurement; an override that is no whole number is ignored."""
        given = os.environ.get(REPEATS_OVERRIDE, "").strip()
        return max(1, int(given) if given.isdecimal() else self.repeats)

    @property
    def skip_processed(self) -> bool:
        """Repeating a measurement means looking at the same runs again."""
        return self.only_unprocessed and self.runs == 1


def universal(suite: str, stages: Sequence[str] = STAGES, **options) -> Strategy:
    return Strategy(f"universal_{suite}", {s: (suite,) for s in stages}, **options)


def staged(extract: str, transform: str, load: str, **options) -> Strategy:
    by_stage = {"E": (extract,), "T": (transform,), "L": (load,)}
    return Strategy(f"staged_{extract}_{transform}_{load}", by_stage, **options)


# The published combinations.
STRATEGIES = {
    s.name: s
    for s in (
        universal("gx"),
        universal("soda"),
        universal("deequ"),
        staged("soda", "sql", "soda"),
        staged("soda", "deequ", "soda"),
        staged("soda", "sql", "dbt"),
        Strategy("all", {"E": ("gx", "soda", "deequ"), "T": ("gx", "soda", "sql", "deequ"), "L": ("gx", "soda", "deequ")}),
    )
}


def from_config(config: Mapping) -> Strategy:
    """A strategy from a parsed tools plan (``experiment: {name, baseline, defaults}``)."""
    plan = config["experiment"]
    defaults = plan.get("defaults") or {}
    repeats = int(defaults.get("repeats") or 1)
    if repeats < 1:
        raise ValueError("repeats must be at least 1")
    by_stage = {str(k).upper(): tuple(v or ()) for k, v in (defaults.get("tools_by_stage") or {}).items()}
    unknown = set(by_stage) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    return Strategy(
        plan.get("name") or "unnamed",
        by_stage,
        repeats,
        bool(defaults.get("include_experiments", True)),
        bool(defaults.get("only_unprocessed", False)),
        dict(plan.get("baseline") or {}),
    )


def from_yaml(path: str) -> Strategy:
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading a YAML plan needs PyYAML; pass a dict to from_config instead") from error
    return from_config(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
