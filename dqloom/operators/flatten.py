"""JSON envelopes -> entity tables and star schema.

Every entity is an explode of its list followed by typed access.  Values that
cannot be converted become NULL (the structure checks report them); ``strict``
raises instead, as a typed load into a database would.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.functions import variant as V
from dqloom.operators.keys import first_per_key
from dqloom.plans.tables import ENTITY_SCHEMAS, STAR

# First row per key: in the order payloads arrived.
ARRIVAL = ("_batch", "_file", "_pos")


def unrolled(df: DataFrame, kept: Sequence[Column | str], elements: Column, position: str, element: str) -> DataFrame:
    """Explode with positions.

    Rows without elements are dropped after the outer explode: an inner one makes
    the optimizer also filter on the list's size, which extracts every list twice.
    """
    return df.select(*kept, F.posexplode_outer(elements).alias(position, element)).filter(F.col(position).isNotNull())


def items(envelopes: DataFrame, entity: str, *, keep_body: bool = False) -> DataFrame:
    """One row per list element of an entity: ``e`` plus arrival order."""
    rows = envelopes.filter(F.col("entity") == entity)
    kept = [F.col("batch_id").alias("_batch"), F.col("source_file").alias("_file")]
    kept += [F.col("body")] if keep_body else []
    return unrolled(rows, kept, V.elements(F.col("body"), entity), "_pos", "e")


def table_rows(envelopes: DataFrame) -> DataFrame:
    """Standings are nested twice: groups ``g`` of table rows ``e``."""
    groups = items(envelopes, "standings", keep_body=True).withColumnsRenamed({"e": "g", "_pos": "_group"})
    rows = unrolled(groups, ["*"], V.elements(F.col("g"), "table"), "_row", "e")
    return rows.withColumn("_pos", F.struct("_group", "_row")).drop("_group", "_row")


class _Reader:
    """Typed access to ``e`` (or another VARIANT column) with one strictness."""

    def __init__(self, strict: bool):
        self.strict = strict

    def number(self, *keys: str, of: str = "e", kind: str = "bigint") -> Column:
        return V.text_number(F.col(of), *keys, kind=kind, strict=self.strict).alias(keys[-1])

    def text(self, *keys: str, of: str = "e") -> Column:
        return V.get(F.col(of), *keys)

    def moment(self, *keys: str, kind: str, of: str = "e") -> Column:
        text = self.text(*keys, of=of)
        if kind == "timestamp_ntz":
            # The offset is dropped: the wall-clock reading is stored.
            text = F.regexp_replace(text, "(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
        return text.cast(kind) if self.strict else text.try_cast(kind)


def _typed(df: DataFrame, schema: str, columns: Mapping[str, Column]) -> DataFrame:
    kinds = dict(part.strip().split(" ", 1) for part in schema.split(","))
    return df.select(*[columns[name].cast(kind).alias(name) for name, kind in kinds.items()])


def star_rows(envelopes: DataFrame, run_id: str, strict: bool = False) -> dict[str, DataFrame]:
    """All candidate rows of the star schema (arrival order attached, keys not yet unique)."""
    r = _Reader(strict)
    run = F.lit(run_id)
    order = {c: F.col(c) for c in ARRIVAL}

    def rows(source: DataFrame, table: str, columns: Mapping[str, Column]) -> DataFrame:
        # Bodies are dropped here: only typed columns reach the shuffle.
        typed = {"run_id": run, **columns}
        kinds = dict(part.strip().split(" ", 1) for part in STAR[table].schema.split(","))
        return source.select(*[typed[n].cast(k).alias(n) for n, k in kinds.items()], *order.values())

    area = rows(
        items(envelopes, "areas"),
        "dim_area",
        {
            "area_id": r.number("id"),
            "name": r.text("name"),
            "country_code": r.text("countryCode"),
            "flag_url": r.text("flag"),
            "parent_area_id": r.number("parentAreaId"),
        },
    )
    competition = rows(
        items(envelopes, "competitions"),
        "dim_competition",
        {
            "competition_id": r.number("id"),
            "area_id": r.number("area", "id"),
            **{c: r.text(c) for c in ("code", "name", "type", "plan")},
        },
    ).filter("area_id IS NOT NULL")
    team = rows(
        items(envelopes, "teams"),
        "dim_team",
        {
            "team_id": r.number("id"),
            "area_id": r.number("area", "id"),
            "name": r.text("name"),
            "short_name": r.text("shortName"),
            "tla": r.text("tla"),
            "crest_url": r.text("crest"),
            "venue": r.text("venue"),
            "address": r.text("address"),
            "founded": r.number("founded"),
            "website": r.text("website"),
            "club_colors": r.text("clubColors"),
        },
    ).filter("area_id IS NOT NULL")

    def season_columns(of: str) -> dict[str, Column]:
        return {
            "season_id": r.number("season", "id", of=of),
            "competition_id": r.number("competition", "id", of=of),
            "start_date": r.moment("season", "startDate", kind="date", of=of),
            "end_date": r.moment("season", "endDate", kind="date", of=of),
            "winner_team_id": r.number("season", "winner", "id", of=of),
        }

    bodies = envelopes.filter("entity = 'standings'").select(
        F.col("batch_id").alias("_batch"), F.col("source_file").alias("_file"), F.lit(-1).alias("_pos"), "body"
    )
    matches = items(envelopes, "matches")
    season = (
        rows(bodies, "dim_season", season_columns("body"))
        .unionByName(rows(matches, "dim_season", season_columns("e")))
        .filter("season_id IS NOT NULL AND competition_id IS NOT NULL")
    )
    match = rows(
        matches,
        "fact_match",
        {
            "match_id": r.number("id"),
            "competition_id": r.number("competition", "id"),
            "season_id": r.number("season", "id"),
            "utc_date": r.moment("utcDate", kind="timestamp_ntz"),
            "status": r.text("status"),
            "stage": r.text("stage"),
            "matchday": r.number("matchday"),
            "home_team_id": r.number("homeTeam", "id"),
            "away_team_id": r.number("awayTeam", "id"),
        },
    )
    score = rows(
        matches,
        "fact_match_score",
        {
            "match_id": r.number("id"),
            "winner": r.text("score", "winner"),
            "duration": r.text("score", "duration"),
            "half_time_home": r.number("score", "halfTime", "home"),
            "half_time_away": r.number("score", "halfTime", "away"),
            "full_time_home": r.number("score", "fullTime", "home"),
            "full_time_away": r.number("score", "fullTime", "away"),
        },
    )
    counters = {
        "position": "position",
        "played_games": "playedGames",
        "won": "won",
        "draw": "draw",
        "lost": "lost",
        "goals_for": "goalsFor",
        "goals_against": "goalsAgainst",
        "goal_difference": "goalDifference",
        "points": "points",
    }
    standing = rows(
        table_rows(envelopes),
        "fact_standing",
        {
            "season_id": r.number("season", "id", of="body"),
            "competition_id": r.number("competition", "id", of="body"),
            "team_id": r.number("team", "id"),
            "standing_type": r.text("type", of="g"),
            "stage": r.text("stage", of="g"),
            **{name: r.number(key) for name, key in counters.items()},
            "form": r.text("form"),
        },
    )
    return {
        "dim_area": area,
        "dim_competition": competition,
        "dim_team": team,
        "dim_season": season,
        "fact_match": match,
        "fact_match_score": score,
        "fact_standing": standing,
    }


def load_star(envelopes: DataFrame, run_id: str, strict: bool = False) -> dict[str, DataFrame]:
    """The star schema of one run: one row per key, the first that arrived.

    Rows whose key is incomplete cannot be stored: ``strict`` raises on one, otherwise ``unkeyed_rows`` holds them.
    """
    out = {}
    for name, rows in star_rows(envelopes, run_id, strict).items():
        key = ["run_id", *STAR[name].key]
        if strict:
            demanded = {k: F.expr(f"coalesce({k}, raise_error('{name} without {k}'))").cast(rows.schema[k].dataType) for k in STAR[name].key}
            present = rows.withColumns(demanded)
        else:
            present = rows.filter(_whole_key(name))
        out[name] = first_per_key(present, key, ARRIVAL).drop(*ARRIVAL)
    return out


def _whole_key(name: str) -> str:
    return "(" + " AND ".join(f"{k} IS NOT NULL" for k in STAR[name].key) + ")"


def unkeyed_rows(envelopes: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """The quarantine of a load: per star table the typed rows that cannot be stored for want of a key."""
    return {name: rows.filter(f"NOT {_whole_key(name)}") for name, rows in star_rows(envelopes, run_id).items()}


def load_entities(envelopes: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """The five un-versioned tables: every element becomes a row, duplicates included."""
    r = _Reader(strict)

    def zero(key: str) -> Column:
        return F.coalesce(r.number(key), F.lit(0))

    def plain(*names: str) -> dict[str, Column]:
        return {n: r.text(n) for n in names}

    numbers = ("position", "playedGames", "won", "draw", "lost", "goalsFor", "goalsAgainst", "goalDifference", "points")
    columns = {
        "areas": {"id": r.number("id"), **plain("name", "countryCode", "flag")},
        "competitions": {"id": r.number("id"), "area_id": r.number("area", "id"), **plain("name", "code", "type", "plan")},
        "teams": {
            "id": r.number("id"),
            "area_id": r.number("area", "id"),
            **plain("name", "shortName", "tla", "crest", "venue", "address"),
        },
        "matches": {
            "id": r.number("id"),
            "competition_id": r.number("competition", "id"),
            "season_id": r.number("season", "id"),
            "utcDate": r.moment("utcDate", kind="timestamp"),
            **plain("status", "stage"),
            "matchday": r.number("matchday"),
            "home_team_id": r.number("homeTeam", "id"),
            "away_team_id": r.number("awayTeam", "id"),
        },
        "standings": {
            "season_id": r.number("season", "id", of="body"),
            "competition_id": r.number("competition", "id", of="body"),
            "team_id": r.number("team", "id"),
            "type": r.text("type", of="g"),
            "stage": r.text("stage", of="g"),
            **{n: zero(n) for n in numbers},
        },
    }
    sources = {e: items(envelopes, e) for e in ("areas", "competitions", "teams", "matches")}
    sources["standings"] = table_rows(envelopes)
    return {e: _typed(sources[e], ENTITY_SCHEMAS[e], columns[e]) for e in ENTITY_SCHEMAS}


def source_keys(envelopes: DataFrame) -> dict[str, DataFrame]:
    """Keys present in the raw payloads, for source completeness and exclusivity checks."""
    r = _Reader(False)
    out = {}
    for entity, key in (("competitions", "competition_id"), ("teams", "team_id"), ("matches", "match_id")):
        out[f"src_{entity}"] = items(envelopes, entity).select(r.number("id").alias(key)).filter(f"{key} IS NOT NULL")
    out["src_standings"] = (
        table_rows(envelopes)
        .select(
            r.number("season", "id", of="body").alias("season_id"),
            r.number("competition", "id", of="body").alias("competition_id"),
            r.number("team", "id").alias("team_id"),
            r.text("type", of="g").alias("standing_type"),
        )
        .filter("season_id IS NOT NULL AND team_id IS NOT NULL")
    )
    return out


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table: ``table, rows``."""
    counts = [df.selectExpr(f"'{name}' AS table", "count(1) AS rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
