"""Synthetic payloads of any size.

Every payload is computed from its own number: ids are arithmetic (unique without
keeping track), "random" values are hashes of the seed and the id.  There is no
shuffle and no state, so the data set grows with the number of tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id ranges of the generated entities.
FIRST_AREA, FIRST_COMPETITION, FIRST_TEAM, FIRST_MATCH = 2000, 2001, 10000, 100000


@dataclass(frozen=True)
class Scale:
    name: str
    areas: int
    competitions: int
    teams: int
    matches: int
    seasons: tuple[int, ...]
    batches: int


# The three presets.
PRESETS = {
    s.name: s
    for s in (
        Scale("small", 5, 3, 8, 38, (2023, 2024), 1),
        Scale("medium", 15, 10, 20, 380, (2022, 2023, 2024, 2025), 4),
        Scale("large", 30, 30, 50, 380, tuple(range(2015, 2026)), 10),
    )
}


def _draw(seed: int, low: int, high: int, *ids: str) -> str:
    """Reproducible integer in [low, high] for the given ids."""
    return f"cast(pmod(xxhash64({seed}, {', '.join(ids)}), {high - low + 1}) + {low} AS INT)"


def payloads(spark: SparkSession, scale: Scale, seed: int = 42, dataset: str | None = None) -> DataFrame:
    """``batch_no, source_file, endpoint, http_status, request_params, response_json`` (text), one row per payload."""
    name = dataset or f"scaled_{scale.name}"
    teams, matches = scale.teams, scale.matches
    tasks = scale.competitions * len(scale.seasons)
    per_batch = max(1, tasks // scale.batches)
    area_of = f"cast({FIRST_AREA} + pmod(xxhash64({seed}, 'area', c), {scale.areas}) AS INT)"
    period = "named_struct('id', y, 'startDate', concat(y, '-08-01'), 'endDate', concat(y + 1, '-05-30'))"

    heads = spark.range(1).selectExpr(
        "1 AS batch_no",
        "inline(array("
        f"named_struct('source_file', '000001_areas.json', 'endpoint', 'areas', 'response_json', to_json(named_struct('areas', "
        f"transform(sequence(0, {scale.areas - 1}), a -> named_struct('id', a + {FIRST_AREA}, 'name', concat('Area ', a), "
        "'countryCode', concat(char(65 + a % 26), char(65 + a div 26)), 'flag', concat('https://flags.example/', a)))))),"
        "named_struct('source_file', '000002_competitions.json', 'endpoint', 'competitions', 'response_json', "
        f"to_json(named_struct('competitions', transform(sequence(0, {scale.competitions - 1}), c -> named_struct("
        f"'id', c + {FIRST_COMPETITION}, 'area', named_struct('id', {area_of}), 'name', concat('League ', c), "
        "'code', concat('L', c), 'type', 'LEAGUE', 'plan', 'TIER_ONE'))))))) ",
    )

    def team(position: str) -> str:
        return f"named_struct('id', {FIRST_TEAM} + c * {teams} + {position}, 'name', concat('Team ', c, '-', {position}))"

    home = _draw(seed, 0, teams - 1, "'home'", "c", "y", "m")
    away = f"({home} + {_draw(seed, 1, teams - 1, "'away'", 'c', 'y', 'm')}) % {teams}"
    winner = _draw(seed, 1, 3, "'winner'", "c", "y", "m")
    match = (
        f"named_struct('id', {FIRST_MATCH} + task * {matches} + m, 'competition', named_struct('id', cid), 'season', {period}, "
        "'utcDate', concat(date_format(date_add(make_date(y, 8, 1), m), 'yyyy-MM-dd'), 'T00:00:00Z'), "
        f"'status', 'FINISHED', 'matchday', m div 10 + 1, 'stage', 'REGULAR_SEASON', "
        f"'homeTeam', {team(home)}, 'awayTeam', {team(away)}, "
        f"'score', named_struct('winner', elt({winner}, 'HOME_TEAM', 'AWAY_TEAM', 'DRAW'), "
        f"'fullTime', named_struct('home', {_draw(seed, 0, 5, "'hg'", 'c', 'y', 'm')}, "
        f"'away', {_draw(seed, 0, 5, "'ag'", 'c', 'y', 'm')})))"
    )
    # Wins and draws are drawn, everything else follows from them, so that clean data passes its own checks.
    won, draw = _draw(seed, 2, 24, "'won'", "c", "y", "t"), _draw(seed, 1, 12, "'draw'", "c", "y", "t")
    scored, conceded = (_draw(seed, 12, 96, repr(k), "c", "y", "t") for k in ("scored", "conceded"))
    row = (
        f"named_struct('position', t + 1, 'team', {team('t')}, 'playedGames', 38, 'won', {won}, 'draw', {draw}, "
        f"'lost', 38 - {won} - {draw}, 'points', {won} * 3 + {draw}, 'goalsFor', {scored}, 'goalsAgainst', {conceded}, "
        f"'goalDifference', {scored} - {conceded})"
    )
    listed_team = (
        f"named_struct('id', {FIRST_TEAM} + c * {teams} + t, 'area', named_struct('id', {area_of}), "
        "'name', concat('Team ', c, '-', t), 'shortName', concat('T', c, '-', t), 'tla', concat('T', t), "
        "'crest', concat('https://crests.example/', c, '/', t), 'address', concat(t, ' Main Street'), 'venue', concat('Ground ', t))"
    )
    bodies = {
        "teams": f"to_json(named_struct('teams', transform(sequence(0, {teams - 1}), t -> {listed_team})))",
        "matches": f"to_json(named_struct('matches', transform(sequence(0, {matches - 1}), m -> {match})))",
        "standings": (
            f"to_json(named_struct('competition', named_struct('id', cid), 'season', {period}, 'standings', array(named_struct("
            f"'stage', 'REGULAR_SEASON', 'type', 'TOTAL', 'table', transform(sequence(0, {teams - 1}), t -> {row})))))"
        ),
    }
    cells = ", ".join(
        f"named_struct('source_file', format_string('%06d_{entity}_comp_%d_season_%d.json', task * 3 + {i} + 3, cid, y), "
        f"'endpoint', concat('competitions/', cid, '/{entity}?season=', y), 'response_json', {body})"
        for i, (entity, body) in enumerate(bodies.items())
    )
    years = ", ".join(str(y) for y in scale.seasons)
    numbered = spark.range(tasks).selectExpr(
        "id AS task",
        f"cast(id div {len(scale.seasons)} AS INT) AS c",
        f"cast(id div {len(scale.seasons)} AS INT) + {FIRST_COMPETITION} AS cid",
        f"array({years})[cast(id % {len(scale.seasons)} AS INT)] AS y",
        f"cast(least({scale.batches}, id div {per_batch} + 1) AS INT) AS batch_no",
    )
    details = numbered.selectExpr("batch_no", f"inline(array({cells}))")
    batch = F.format_string(f"{name}_b%03d", "batch_no")
    return heads.unionByName(details).select(
        "batch_no",
        "source_file",
        "endpoint",
        F.lit(200).alias("http_status"),
        F.create_map(F.lit("dag_id"), F.lit("generator"), F.lit("run_id"), batch, F.lit("batch_id"), batch).alias("request_params"),
        "response_json",
    )


def manifest(generated: DataFrame) -> DataFrame:
    """Files and entity counts per batch."""
    sizes = {
        e: F.coalesce(F.sum(F.when(F.col("endpoint").contains(f"/{e}?"), F.json_array_length(F.get_json_object("response_json", f"$.{e}")))), F.lit(0)).alias(e)
        for e in ("teams", "matches", "standings")
    }
    return generated.groupBy("batch_no").agg(F.count(F.lit(1)).alias("files"), *sizes.values())


def write_payloads(generated: DataFrame, folder: str) -> None:
    """Payloads as JSON lines, one directory per batch, in a layout ``read_envelopes(lines=True)`` reads."""
    body = generated.withColumns(
        {"response_json": F.parse_json("response_json"), "batch_no": F.format_string("%04d", "batch_no")}
    )
    body.write.mode("errorifexists").partitionBy("batch_no").json(folder)


def as_envelopes(generated: DataFrame, run_id: str) -> DataFrame:
    """The same payloads as envelopes, without going through files."""
    from dqloom.sources import envelopes

    staged = generated.withColumns(
        {"response_json": F.parse_json("response_json"), "batch_id": F.format_string(f"{run_id}_b%04d", "batch_no")}
    )
    return envelopes.as_envelopes(staged, run_id)
