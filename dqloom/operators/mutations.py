"""Controlled defects as table-to-table transforms.

Every mutation is deterministic: "first" is the smallest key and "random" is the
smallest hash of (seed, key), both found by a distributed top-n.  Nothing is
collected; the picked keys stay in the plan as an n-row side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.functions import variant as V

# Fixed values written by the mutations.
ANOMALY_ID = 99999901
MUTATED = "MUTATED"
MUTATED_NAME, MUTATED_CODE = "MUTATED_COMP", "MUT"
BAD_MATCHDAY = 999
BAD_ID = "abc"
ANOMALY_DATE = "2025-01-01 00:00:00"
SWAP_COUNT, MATCHDAY_COUNT = 5, 3
REQUIRED_FIELDS = ("id", "name", "utcDate")


def mutation_seed(run_id: str, layer: str, entity: str, action: str) -> str:
    return f"{run_id}:{layer}:{entity}:{action}"


def picked(df: DataFrame, key: str, n: int, seed: str | None) -> DataFrame:
    """At most ``n`` key values: the smallest, or the smallest by seeded hash."""
    order = F.col(key) if seed is None else F.xxhash64(F.lit(seed), F.col(key))
    rows = df.filter(F.col(key).isNotNull()).select(key).orderBy(order, key).limit(max(1, n))
    return rows.distinct().select(F.col(key).alias("_key"), F.lit(True).alias("_hit"))


def _marked(df: DataFrame, key: str, n: int, seed: str | None) -> DataFrame:
    # At most n rows by construction; the join strategy is left to Spark.
    return df.join(picked(df, key, n, seed), F.col(key) == F.col("_key"), "left").drop("_key")


def swap_teams(matches: DataFrame, n: int = SWAP_COUNT, seed: str | None = None, key: str = "id") -> DataFrame:
    """Exchange home and away on ``n`` matches."""
    home, away = F.col("home_team_id"), F.col("away_team_id")
    swapped = {
        "home_team_id": F.when(F.col("_hit"), away).otherwise(home),
        "away_team_id": F.when(F.col("_hit"), home).otherwise(away),
    }
    return _marked(matches, key, n, seed).withColumns(swapped).select(*matches.columns)


def collapse_teams(matches: DataFrame, n: int = SWAP_COUNT, seed: str | None = None, key: str = "id") -> DataFrame:
    """Make the away team play itself on ``n`` matches."""
    home = F.when(F.col("_hit"), F.col("away_team_id")).otherwise(F.col("home_team_id"))
    return _marked(matches, key, n, seed).withColumn("home_team_id", home).select(*matches.columns)


def first_row(df: DataFrame, key: str = "id") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.orderBy(F.asc_nulls_last(key), *rest).limit(1)


def duplicate_first(df: DataFrame, key: str = "id") -> DataFrame:
    """Append a copy of the first row."""
    return df.unionByName(first_row(df, key))


def drop_required(df: DataFrame, key: str = "id") -> DataFrame:
    """Lose the key of the first row."""
    first = df.agg(F.min(key)).scalar()
    return df.withColumn(key, F.when(F.col(key) == first, F.lit(None)).otherwise(F.col(key)))


def corrupt_id(df: DataFrame, key: str = "id") -> DataFrame:
    """An unreadable key becomes NULL in a typed table."""
    return drop_required(df, key)


def matchday_out_of_range(matches: DataFrame, n: int = MATCHDAY_COUNT, key: str = "id") -> DataFrame:
    day = F.when(F.col("_hit"), F.lit(BAD_MATCHDAY)).otherwise(F.col("matchday"))
    return _marked(matches, key, n, None).withColumn("matchday", day).select(*matches.columns)


def drop_matches_key(matches: DataFrame) -> DataFrame:
    """A payload without its list leaves an empty table."""
    return matches.filter(F.lit(False))


@dataclass(frozen=True)
class Layout:
    """Column names of one flavour of the tables."""

    match_key: str
    match_date: str
    standing_type: str
    competition_key: str
    team_key: str


ENTITY_LAYOUT = Layout("id", "utcDate", "type", "id", "id")
STAR_LAYOUT = Layout("match_id", "utc_date", "standing_type", "competition_id", "team_id")


def _anchor(matches: DataFrame, competitions: DataFrame, teams: DataFrame, seasons: DataFrame | None, at: Layout) -> DataFrame:
    """One row ``competition_id, season_id, team_id`` to hang a planted row on.

    The busiest competition and the first match in it; the smallest known keys
    where matches give nothing.
    """
    busiest = (
        matches.filter("competition_id IS NOT NULL")
        .groupBy("competition_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "competition_id")
        .limit(1)
        .select("competition_id")
    )
    first = (
        matches.filter(F.col("competition_id") == busiest.scalar())
        .filter("season_id IS NOT NULL AND (home_team_id IS NOT NULL OR away_team_id IS NOT NULL)")
        .selectExpr(f"{at.match_key} AS k", "season_id", "coalesce(home_team_id, away_team_id) AS team_id")
        .orderBy(F.asc_nulls_last("k"), "season_id", "team_id")
        .limit(1)
    )
    season_fallback = (seasons if seasons is not None else matches).agg(F.min("season_id")).scalar()
    return matches.sparkSession.range(1).select(
        F.coalesce(busiest.scalar(), competitions.agg(F.min(at.competition_key)).scalar()).alias("competition_id"),
        F.coalesce(first.select("season_id").scalar(), season_fallback).alias("season_id"),
        F.coalesce(first.select("team_id").scalar(), teams.agg(F.min(at.team_key)).scalar()).alias("team_id"),
    )


def _planted(df: DataFrame, anchor: DataFrame, values: Mapping[str, object], keys: Sequence[str]) -> DataFrame:
    """The row to append, built from the anchor; none where its key exists.  Types follow the table."""
    kinds = dict(df.dtypes)
    cells = []
    for c in df.columns:
        source = values.get(c, "0" if c not in ("form", "run_id") else "NULL")
        cells.append(f"cast({source} AS {kinds[c]}) AS {c}")
    row = anchor.filter("competition_id IS NOT NULL AND season_id IS NOT NULL AND team_id IS NOT NULL").selectExpr(*cells)
    anchored = [k for k in keys if values.get(k) in anchor.columns]
    fixed = [k for k in keys if k not in anchored]
    present = df.filter(" AND ".join(f"{k} = {values[k]}" for k in fixed)) if fixed else df
    if anchored:
        row = row.join(present.select(*anchored), anchored, "left_anti").select(*df.columns)
    else:
        # The whole key is known, so its presence is a single number.
        row = row.filter(present.agg(F.count(F.lit(1))).scalar() == 0)
    return row


def planted_match(tables: Mapping[str, DataFrame], at: Layout, run_id: str | None = None, names: Mapping[str, str] | None = None) -> DataFrame:
    """The row of a match without teams, with an impossible matchday and status."""
    n = names or {}
    matches = tables[n.get("matches", "matches")]
    anchor = _anchor(
        matches,
        tables[n.get("competitions", "competitions")],
        tables[n.get("teams", "teams")],
        tables[n["seasons"]] if "seasons" in n else None,
        at,
    )
    values = {
        at.match_key: ANOMALY_ID,
        "competition_id": "competition_id",
        "season_id": "season_id",
        at.match_date: f"'{ANOMALY_DATE}'",
        "status": f"'{MUTATED}'",
        "stage": f"'{MUTATED}'",
        "matchday": BAD_MATCHDAY,
        "home_team_id": "NULL",
        "away_team_id": "NULL",
    }
    keys = [at.match_key]
    if run_id is not None:
        values["run_id"] = f"'{run_id}'"
        keys = ["run_id", *keys]
    return _planted(matches, anchor, values, keys)


def insert_bad_match(tables: Mapping[str, DataFrame], at: Layout, run_id: str | None = None, names: Mapping[str, str] | None = None):
    """The matches with ``planted_match``."""
    return tables[(names or {}).get("matches", "matches")].unionByName(planted_match(tables, at, run_id, names))


def _without_standing(anchor: DataFrame, standings: DataFrame, teams: DataFrame, at: Layout) -> DataFrame:
    """The anchor with the smallest team that has no standing there yet, so that only the zeros are wrong."""
    row = anchor.select("competition_id", "season_id")
    ranked = standings.filter(
        (F.col("competition_id") == row.select("competition_id").scalar()) & (F.col("season_id") == row.select("season_id").scalar())
    ).select("team_id")
    free = teams.select(F.col(at.team_key).alias("team_id")).join(ranked, "team_id", "left_anti").agg(F.min("team_id"))
    return anchor.withColumn("team_id", F.coalesce(free.scalar(), F.col("team_id")))


def planted_standing(tables: Mapping[str, DataFrame], at: Layout, run_id: str | None = None, names: Mapping[str, str] | None = None) -> DataFrame:
    """A standing row in which nothing was ever played."""
    n = names or {}
    standings, teams = tables[n.get("standings", "standings")], tables[n.get("teams", "teams")]
    anchor = _anchor(
        tables[n.get("matches", "matches")],
        tables[n.get("competitions", "competitions")],
        teams,
        tables[n["seasons"]] if "seasons" in n else None,
        at,
    )
    values = {
        "season_id": "season_id",
        "competition_id": "competition_id",
        "team_id": "team_id",
        at.standing_type: f"'{MUTATED}'",
        "stage": f"'{MUTATED}'",
    }
    keys = ["season_id", "competition_id", "team_id", at.standing_type]
    if run_id is None:
        anchor = _without_standing(anchor, standings, teams, at)
    else:
        values["run_id"] = f"'{run_id}'"
        keys = ["run_id", *keys]
    return _planted(standings, anchor, values, keys)


def insert_zero_standing(tables: Mapping[str, DataFrame], at: Layout, run_id: str | None = None, names: Mapping[str, str] | None = None):
    """The standings with ``planted_standing``."""
    return tables[(names or {}).get("standings", "standings")].unionByName(planted_standing(tables, at, run_id, names))


def corrupt_competition(competitions: DataFrame, target, key: str = "id", overwrite: bool = True) -> DataFrame:
    """Rename one competition; code, type and plan are overwritten or only filled in."""
    hit = F.col(key) == target
    marks = {"code": MUTATED_CODE, "type": MUTATED, "plan": MUTATED}
    changed = {"name": F.when(hit, MUTATED_NAME).otherwise(F.col("name"))}
    for c, mark in marks.items():
        value = F.lit(mark) if overwrite else F.coalesce(c, F.lit(mark))
        changed[c] = F.when(hit, value).otherwise(F.col(c))
    return competitions.withColumns(changed)


def clear_columns(df: DataFrame, *columns: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns})


Mutation = Callable[[Mapping[str, DataFrame]], dict[str, DataFrame]]


def _on(table: str, change: Callable[[DataFrame], DataFrame]) -> Mutation:
    return lambda tables: {table: change(tables[table])}


def _entity_competition(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    comps = tables["competitions"]
    return {"competitions": corrupt_competition(comps, comps.agg(F.min("id")).scalar())}


def entity_mutation(action: str, entity: str = "matches", n: int | None = None, seed: str | None = None) -> Mutation:
    """A mutation of the five un-versioned tables, by name."""
    count = n or SWAP_COUNT
    registry: dict[str, Mutation] = {
        "swap_teams": _on("matches", lambda df: swap_teams(df, count, seed)),
        "collapse_teams": _on("matches", lambda df: collapse_teams(df, count, seed)),
        "duplicate_first": _on(entity, duplicate_first),
        "drop_required": _on(entity, drop_required),
        "corrupt_id": _on(entity, corrupt_id),
        "matchday_out_of_range": _on("matches", lambda df: matchday_out_of_range(df, n or MATCHDAY_COUNT)),
        "drop_matches_key": _on("matches", drop_matches_key),
        "fact_match": lambda t: {"matches": insert_bad_match(t, ENTITY_LAYOUT)},
        "fact_standing": lambda t: {"standings": insert_zero_standing(t, ENTITY_LAYOUT)},
        "dim_competition": _entity_competition,
        "season_dates_missing": _on("matches", lambda df: clear_columns(df, "utcDate")),
    }
    return registry[action]


STAR_NAMES = {
    "matches": "fact_match",
    "standings": "fact_standing",
    "competitions": "dim_competition",
    "teams": "dim_team",
    "seasons": "dim_season",
}


def star_mutation(action: str, run_id: str) -> Mutation:
    """A mutation of the versioned star schema, by name."""

    def competition(t: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        anchor = _anchor(t["fact_match"], t["dim_competition"], t["dim_team"], t["dim_season"], STAR_LAYOUT)
        target = anchor.select("competition_id").scalar()
        return {"dim_competition": corrupt_competition(t["dim_competition"], target, "competition_id", overwrite=False)}

    registry: dict[str, Mutation] = {
        "fact_match": lambda t: {"fact_match": insert_bad_match(t, STAR_LAYOUT, run_id, STAR_NAMES)},
        "fact_standing": lambda t: {"fact_standing": insert_zero_standing(t, STAR_LAYOUT, run_id, STAR_NAMES)},
        "dim_competition": competition,
        "season_dates_missing": lambda t: {
            "dim_season": clear_columns(t["dim_season"], "start_date", "end_date"),
            "fact_match": clear_columns(t["fact_match"], "utc_date"),
        },
    }
    return registry[action]


def apply(tables: Mapping[str, DataFrame], *mutations: Mutation) -> dict[str, DataFrame]:
    """The tables after the mutations, in order; the originals stay untouched."""
    out = {name: tables[name] for name in tables}
    for mutation in mutations:
        out.update(mutation(out))
    return out


# --- mutations of raw JSON payloads ----------------------------------------------------------------------------------


def _rewrite_list(envelopes: DataFrame, entity: str, change: Callable) -> DataFrame:
    """Replace the list of an entity in every payload of it; payloads without elements stay as they are."""
    body = F.col("body")
    elements = V.elements(body, entity)
    changed = V.put(V.as_object(body), entity, V.to_variant(change(elements)))
    hit = (F.col("entity") == entity) & (F.size(elements) > 0)
    return envelopes.withColumn("body", F.when(hit, V.to_variant(changed)).otherwise(body))


def _edit_first(elements, edit: Callable):
    """Apply ``edit`` (on an object's fields) to the first element."""
    first = elements[0]
    fields = V.as_object(first)
    edited = F.when(fields.isNotNull(), V.to_variant(edit(fields))).otherwise(first)
    return F.concat(F.array(edited), F.slice(elements, 2, F.size(elements)))


def _drop_first_present(fields):
    target = F.lit(None).cast("string")
    for name in reversed(REQUIRED_FIELDS):
        target = F.when(F.map_contains_key(fields, F.lit(name)), F.lit(name)).otherwise(target)
    return F.when(target.isNotNull(), V.drop(fields, target)).otherwise(fields)


def _only_if_present(fields, key: str, value):
    return F.when(F.map_contains_key(fields, F.lit(key)), V.put(fields, key, value)).otherwise(fields)


def _json(value: str):
    return F.parse_json(F.lit(f'"{value}"'))


def _swap_in_payload(elements, n: int, seed: str):
    """Exchange the two team objects on the n elements with the smallest seeded hash."""
    ranked = F.array_sort(
        F.transform(elements, lambda e, i: F.struct(F.xxhash64(F.lit(seed), i, V.get(e, "id")).alias("h"), i.alias("i")))
    )
    chosen = F.transform(F.slice(ranked, 1, max(1, n)), lambda p: p["i"])

    def swapped(e, i):
        home, away = F.try_variant_get(e, "$.homeTeam", "variant"), F.try_variant_get(e, "$.awayTeam", "variant")
        both = V.is_object(e, "homeTeam") & V.is_object(e, "awayTeam")
        fields = V.put(V.put(V.as_object(e), "homeTeam", away), "awayTeam", home)
        return F.when(F.array_contains(chosen, i) & both, V.to_variant(fields)).otherwise(e)

    return F.transform(elements, swapped)


def mutate_payloads(envelopes: DataFrame, entity: str, action: str, n: int = SWAP_COUNT, seed: str = "") -> DataFrame:
    """A mutation of the raw bodies; unknown combinations leave the payloads unchanged."""
    if action == "drop_matches_key" and entity == "matches":
        rest = V.to_variant(V.drop(V.as_object(F.col("body")), "matches"))
        hit = (F.col("entity") == entity) & V.has_key(F.col("body"), "matches")
        return envelopes.withColumn("body", F.when(hit, rest).otherwise(F.col("body")))
    changes = {
        "duplicate_first": lambda e: F.concat(e, F.slice(e, 1, 1)),
        "drop_required": lambda e: _edit_first(e, _drop_first_present),
        "corrupt_id": lambda e: _edit_first(e, lambda f: _only_if_present(f, "id", _json(BAD_ID))),
    }
    if entity == "matches":
        changes["matchday_out_of_range"] = lambda e: _edit_first(e, lambda f: V.put(f, "matchday", _json(str(BAD_MATCHDAY))))
        changes["swap_teams"] = lambda e: _swap_in_payload(e, n, seed)
    return _rewrite_list(envelopes, entity, changes[action]) if action in changes else envelopes
