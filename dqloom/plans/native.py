"""Payload and star-schema validators with severities, grouped into gated suites."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.functions import routing
from dqloom.functions import variant as V
from dqloom.operators import checks as C
from dqloom.operators import flatten, fusion, structure
from dqloom.operators.checks import Check, Ref, Suite
from dqloom.operators.marts import uneven_home_away
from dqloom.plans.suites import STATUS
from dqloom.sources import envelopes as E

# Payload validators by suite, in the order the suites gate.
PAYLOAD_SUITES = {
    "schema": [f"{e}_schema" for e in ("areas", "competitions", "teams", "scorers", "matches", "standings")],
    "completeness": [f"{e}_completeness" for e in ("areas", "competitions", "teams", "scorers", "matches", "standings")],
    "uniqueness": [f"{e}_uniqueness" for e in ("areas", "competitions", "teams", "scorers", "matches", "standings")],
    "consistency": [f"{e}_consistency" for e in ("competitions", "matches", "standings", "teams", "scorers")],
}
# Payload validators that only warn.
WARNING_ONLY = frozenset(
    (
        "scorers_schema",
        "standings_schema",
        "standings_completeness",
        "standings_uniqueness",
        "standings_consistency",
        "teams_consistency",
        "scorers_consistency",
    )
)

INGESTION = Suite(
    "ingestion",
    {
        "STG": (
            C.rows_where("api_http_status_ok", "envelopes", "http_status < 200 OR http_status >= 300", "ingestion"),
            C.rows_where("api_payload_shape_ok", "envelopes", "entity IS NOT NULL AND NOT has_key", "ingestion"),
        )
    },
)


def envelope_facts(envelopes: DataFrame) -> DataFrame:
    """Per envelope: status, entity and whether the entity's list key is present."""
    has_key = F.lit(None).cast("boolean")
    for entity in routing.ENDPOINT_PATTERNS:
        has_key = F.when(F.col("entity") == entity, V.has_key(F.col("body"), entity)).otherwise(has_key)
    return envelopes.select("http_status", "entity", has_key.alias("has_key"))


def _ref(label: str, child: str, parent: str, parent_column: str) -> Ref:
    return Ref(label, ("run_id", child), parent, ("run_id", parent_column))


def _source_pair(entity: str, target: str, keys: tuple[str, ...]) -> tuple[Check, Check]:
    source = f"src_{entity}"
    return (
        C.all_loaded(f"{entity}_source_completeness", source, keys, target, keys),
        C.none_invented(f"{entity}_source_exclusivity", target, keys, source, keys),
    )


_PAIRS = [
    _source_pair("competitions", "dim_competition", ("competition_id",)),
    _source_pair("teams", "dim_team", ("team_id",)),
    _source_pair("matches", "fact_match", ("match_id",)),
    tuple(
        c.warning()
        for c in _source_pair("standings", "fact_standing", ("season_id", "competition_id", "team_id", "standing_type"))
    ),
]

STAR_GATES = {
    "referential": (
        C.orphans(
            "fact_match_fk",
            "fact_match",
            _ref("home_team", "home_team_id", "dim_team", "team_id"),
            _ref("away_team", "away_team_id", "dim_team", "team_id"),
            _ref("season", "season_id", "dim_season", "season_id"),
        ),
        C.orphans("fact_standing_fk", "fact_standing", _ref("team", "team_id", "dim_team", "team_id")).warning(),
        C.orphans("dim_competition_area_fk", "dim_competition", _ref("area", "area_id", "dim_area", "area_id")),
    ),
    "source_completeness": tuple(p[0] for p in _PAIRS),
    "source_exclusivity": tuple(p[1] for p in _PAIRS),
    "rules": (
        C.rows_where("match_home_away_diff", "fact_match", "home_team_id = away_team_id", "rules"),
        C.rows_where("match_status_valid", "fact_match", STATUS, "rules").warning(),
        C.rows_where("standings_points_consistency", "fact_standing", "won * 3 + draw <> points", "rules").warning(),
        C.rows_where("season_round_robin", "round_robin", "home_matches <> away_matches", "rules").warning(),
    ),
}

NATIVE_STAR = Suite("native", {name: checks for name, checks in STAR_GATES.items()})


def star_inputs(star: Mapping[str, DataFrame], envelopes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables the star-schema gates read."""
    inputs = {n: star[n] for n in star}
    inputs["round_robin"] = uneven_home_away(star["fact_match"], star["dim_season"])
    return {**inputs, **(flatten.source_keys(envelopes) if envelopes is not None else {})}


def payload_results(envelopes: DataFrame, suites: Sequence[str] = tuple(PAYLOAD_SUITES)) -> DataFrame:
    """Result frame of the payload validators.

    Errors FAIL (or WARN for a validator that only warns); a validator with
    nothing but warnings passes with a message.  Validators of an entity without
    any payload are skipped.
    """
    found = structure.findings(envelopes, suites)
    wanted = [(suite, v) for suite in suites for v in PAYLOAD_SUITES[suite]]
    counts = []
    for i, (_, v) in enumerate(wanted):
        counts += [f"count_if(validator = '{v}' AND level = '{level}') AS {level[0]}{i}" for level in ("error", "warning")]
    # One small map (an entry per entity) from one pass over the envelopes.
    per_entity = envelopes.filter("entity IS NOT NULL").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    seen = per_entity.agg(F.map_from_entries(F.collect_list(F.struct("entity", "n"))))
    one = found.selectExpr(*counts).withColumn("seen", seen.scalar())
    cells = []
    for i, (suite, v) in enumerate(wanted):
        severity = C.WARNING if v in WARNING_ONLY else C.ERROR
        cells.append(
            f"named_struct('suite', '{suite}', 'name', '{v}', 'sev', '{severity}', 'errors', e{i}, 'warnings', w{i}, "
            f"'payloads', coalesce(try_element_at(seen, '{v.split('_')[0]}'), 0))"
        )
    status = f"CASE WHEN payloads = 0 THEN '{C.SKIP}' ELSE {fusion.status_of('errors', 'sev')} END"
    return one.selectExpr(f"inline(array({', '.join(cells)}))").selectExpr(
        "suite",
        "'STG' AS stage",
        "name AS check_name",
        "suite AS rule_group",
        "sev AS severity",
        f"{status} AS status",
        "errors AS rows_failed",
        "CASE WHEN warnings > 0 THEN concat(warnings, ' warnings') END AS message",
    )


def latest_payload_results(envelopes: DataFrame, run_id: str) -> DataFrame:
    """The payload validators on the newest good payload of every entity of a run.

    A validator belongs to the entity its name starts with; entities without a
    payload are skipped.
    """
    return payload_results(E.latest_per_entity(envelopes.filter(F.col("run_id") == run_id)))


def ingestion_results(envelopes: DataFrame) -> DataFrame:
    return fusion.evaluate("ingestion", "STG", INGESTION.checks("STG"), {"envelopes": envelope_facts(envelopes)})


class GateFailed(ValueError):
    """A gating check failed; ``results`` holds everything evaluated so far."""

    def __init__(self, gate: str, failed: Sequence[str], results: list):
        super().__init__(f"gate {gate} failed: {', '.join(failed)}")
        self.gate, self.failed, self.results = gate, list(failed), results


def run_gates(gates: Sequence[tuple[str, Callable[[], DataFrame]]], enforce: bool = True) -> tuple[list, str | None]:
    """Evaluate gates in order and stop at the first one with a FAIL or ERROR.

    Returns the result rows and the name of the gate that stopped the run (None
    when all passed); ``enforce`` raises instead.
    """
    rows: list = []
    for name, build in gates:
        current = build().collect()
        rows += current
        failed = [r["check_name"] for r in current if r["status"] in (C.FAIL, C.BROKEN)]
        if failed:
            if enforce:
                raise GateFailed(name, failed, rows)
            return rows, name
    return rows, None


def until_failure(results: DataFrame, gates: Sequence[str], gate_column: str) -> tuple[list, str | None]:
    """Results of gates evaluated together, in the order of the gates, up to the first gate with a FAIL or ERROR."""
    found = results.collect()  # one row per check
    rows: list = []
    for gate in gates:
        current = [r for r in found if r[gate_column] == gate]
        rows += current
        if any(r["status"] in (C.FAIL, C.BROKEN) for r in current):
            return rows, gate
    return rows, None


def staging_gates(envelopes: DataFrame) -> list[tuple[str, Callable[[], DataFrame]]]:
    gates = [("ingestion", lambda: ingestion_results(envelopes))]
    return gates + [(s, lambda s=s: payload_results(envelopes, [s])) for s in PAYLOAD_SUITES]


def star_gates(star: Mapping[str, DataFrame], envelopes: DataFrame) -> list[tuple[str, Callable[[], DataFrame]]]:
    inputs = star_inputs(star, envelopes)
    return [(s, lambda s=s: fusion.evaluate("native", s, STAR_GATES[s], inputs)) for s in STAR_GATES]
