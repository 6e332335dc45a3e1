"""Classification of endpoints and run ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities in load order and the endpoint each one is served by.
ENDPOINT_PATTERNS = {
    "areas": "^areas$",
    "competitions": "^competitions$",
    "teams": "^competitions/.*/teams",
    "scorers": "^competitions/.*/scorers",
    "matches": "^competitions/.*/matches",
    "standings": "^competitions/.*/standings",
}

# Endpoints an export keeps, besides the two plain ones, and the seasons it keeps by default.
EXPORT_ENDPOINT = r"^competitions/(\d+)/(teams|scorers|matches|standings)\?season=(\d+)(?:&limit=\d+)?$"
EXPORT_SEASONS = (2023, 2024, 2025)

# Prefix of experiment runs and the two kinds.
EXPERIMENT_PREFIX = "exp_"
BASELINE, EXPERIMENT = "baseline", "experiment"


def entity_of(endpoint: Column) -> Column:
    """Entity an endpoint serves, NULL when it serves none."""
    routed = F.lit(None).cast("string")
    for entity, pattern in reversed(ENDPOINT_PATTERNS.items()):
        routed = F.when(endpoint.rlike(pattern), F.lit(entity)).otherwise(routed)
    return routed


def run_kind(run_id: Column) -> Column:
    return F.when(run_id.startswith(EXPERIMENT_PREFIX), F.lit(EXPERIMENT)).otherwise(F.lit(BASELINE))


def endpoint_slug(endpoint: Column) -> Column:
    """File-name friendly form of an endpoint."""
    spaced = F.regexp_replace(F.regexp_replace(endpoint, "[/?&]", "__"), "=", "_")
    return F.btrim(F.regexp_replace(spaced, "[^a-zA-Z0-9_.-]+", "_"), F.lit("_"))


def exportable(endpoint: Column, seasons: Sequence[int] | None = EXPORT_SEASONS) -> Column:
    """True for endpoints an export keeps; ``seasons`` None keeps every season."""
    own = endpoint.rlike(EXPORT_ENDPOINT)
    if seasons is not None:
        own = own & F.regexp_extract(endpoint, EXPORT_ENDPOINT, 3).isin(*map(str, seasons))
    return endpoint.isin("areas", "competitions") | own


def export_parts(endpoint: Column) -> dict[str, Column]:
    """competition id, entity and season named by an export endpoint (NULL when absent)."""

    def part(group: int, kind: str) -> Column:
        return F.nullif(F.regexp_extract(endpoint, EXPORT_ENDPOINT, group), F.lit("")).cast(kind)

    return {"competition_id": part(1, "int"), "entity": part(2, "string"), "season": part(3, "int")}


def stage_of(layer: Column) -> Column:
    """Tool layers are named stage_tool."""
    return F.split_part(layer, F.lit("_"), F.lit(1))
