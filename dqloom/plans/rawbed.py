"""Raw JSON payloads derived from the events table.

Every event becomes one API response.  Its type picks the endpoint, ``k`` of its
properties picks the number of list elements (0 to 3) and which defects it
carries, so every event is used and the defects can be stated in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.functions import routing
from dqloom.functions import variant as V

RUN = "raw_run"
# Tasks per core that build payloads: an event takes a few bytes of a file and much time.
TASKS_PER_CORE = 3
# Event types and the endpoints they stand for ({u} is the user).
ENDPOINTS = {
    "click": "competitions/{u}/matches?season=2024",
    "view": "competitions/{u}/teams?season=2024",
    "purchase": "competitions/{u}/standings?season=2024",
    "signup": "competitions",
    "error": "areas",
}


def _list(element: str) -> str:
    """JSON text of the elements i = 0 .. n-1."""
    return f"array_join(transform(slice(array(0, 1, 2), 1, n), i -> concat('{{', {element}, '}}')), ',')"


def _text(value: str) -> str:
    return f"concat('\"', {value}, '\"')"


def _pairs(**fields: str) -> str:
    parts = [f"'\"{name}\":', {value}" for name, value in fields.items()]
    return ", ',', ".join(parts)


_PERIOD = '{"id":2024,"startDate":"2024-01-01","endDate":"2024-01-20"}'
_ID = (
    "CASE WHEN k % 7 = 0 AND i = 0 THEN '' WHEN k % 11 = 0 AND i = 0 THEN '\"id\":\"abc\",' "
    "WHEN k % 13 = 0 AND i = 1 THEN concat('\"id\":', event_id * 10, ',') ELSE concat('\"id\":', event_id * 10 + i, ',') END"
)
_MATCHDAY = (
    "CASE WHEN k % 17 = 0 THEN '\"999\"' WHEN k % 19 = 0 THEN '\"x7\"' WHEN k % 5 = 0 THEN 'null' ELSE cast(i + 1 AS STRING) END"
)
_MATCH = f"{_ID}, " + _pairs(
    utcDate="date_format(ts, '\"yyyy-MM-dd\\'T\\'HH:mm:ss\\'Z\"\\'')",
    status="'\"FINISHED\"'",
    matchday=_MATCHDAY,
    homeTeam="concat('{\"id\":', user_id, '}')",
    awayTeam="concat('{\"id\":', user_id + CASE WHEN k % 23 = 0 THEN 0 ELSE 1 END, '}')",
    competition="concat('{\"id\":', user_id, '}')",
    season=f"'{_PERIOD}'",
    score="concat('{\"winner\":\"DRAW\",\"duration\":\"REGULAR\",\"fullTime\":{\"home\":', i, ',\"away\":', i, '}}')",
)
_TEAM = f"{_ID}, " + _pairs(
    name="CASE WHEN k % 17 = 0 THEN '\"\"' ELSE concat('\"Team \', event_id, \'\"') END",
    founded="CASE WHEN k % 19 = 0 THEN '\"\"' ELSE cast(1900 + k AS STRING) END",
    area="CASE WHEN k % 5 = 0 THEN '{}' ELSE concat('{\"id\":', k, '}') END",
)
_AREA = f"{_ID}, " + _pairs(
    name="concat('\"Area \', event_id, \'\"')",
    countryCode="CASE WHEN k % 17 = 0 THEN '\"X\"' WHEN k % 19 = 0 THEN 'null' ELSE '\"XY\"' END",
    parentAreaId="CASE WHEN k % 5 = 0 THEN 'null' ELSE cast(k AS STRING) END",
)
_COMPETITION = f"{_ID}, " + _pairs(
    name="concat('\"League \', event_id, \'\"')",
    type="'\"LEAGUE\"'",
    area="CASE WHEN k % 5 = 0 THEN '{}' ELSE concat('{\"id\":', k, '}') END",
    currentSeason=(
        "CASE WHEN k % 17 = 0 THEN '{\"startDate\":\"2024-05-01\",\"endDate\":\"2024-01-01\"}' "
        "WHEN k % 19 = 0 THEN '{\"startDate\":\"2024-05-01\"}' ELSE '{\"startDate\":\"2024-01-01\",\"endDate\":\"2024-05-01\"}' END"
    ),
) + ", CASE WHEN k % 3 = 0 THEN '' ELSE ',\"plan\":\"TIER_ONE\"' END"
_ROW = _pairs(
    team="concat('{\"id\":', event_id * 10 + CASE WHEN k % 13 = 0 THEN 0 ELSE i END, '}')",
    position="cast(i + 1 AS STRING)",
    points="cast(i * 4 AS STRING)",
    playedGames="cast(i + 1 AS STRING)",
    won="cast(i AS STRING)",
    draw="cast(i AS STRING)",
)


def payloads(t: Mapping) -> DataFrame:
    """``event_id, k, n, ts, endpoint, http_status, body`` (JSON text) for every event.

    A file of events is too small to be split among all cores, so its rows are dealt out first.
    """
    events = t["events"].select("event_id", "ts", "user_id", "event_type", "props")
    tasks = TASKS_PER_CORE * events.sparkSession.sparkContext.defaultParallelism
    keyed = events.repartition(tasks, "event_id", "ts").selectExpr(
        "event_id", "ts", "user_id", "event_type", "cast(get_json_object(props, '$.k') AS INT) AS k"
    )
    numbered = keyed.selectExpr("*", "k % 4 AS n")
    endpoint = "CASE event_type " + " ".join(
        "WHEN '{}' THEN {}".format(kind, "concat('" + path.replace("{u}", "', user_id, '") + "')") for kind, path in ENDPOINTS.items()
    ) + " END"
    count = "'\"count\":', n + CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END, ','"

    def listed(name: str, element: str) -> str:
        return f"concat('{{', {count}, '\"{name}\":[', {_list(element)}, ']}}')"

    standings = (
        f"concat('{{\"competition\":{{\"id\":', user_id, '}},\"season\":{_PERIOD},\"standings\":[{{\"type\":\"TOTAL\",\"table\":[', "
        f"{_list(_ROW)}, ']}}]}}')"
    )
    body = (
        "CASE WHEN k % 29 = 0 THEN '{}' "
        f"WHEN event_type = 'click' THEN {listed('matches', _MATCH)} WHEN event_type = 'view' THEN {listed('teams', _TEAM)} "
        f"WHEN event_type = 'purchase' THEN {standings} WHEN event_type = 'signup' THEN {listed('competitions', _COMPETITION)} "
        f"ELSE {listed('areas', _AREA)} END"
    )
    return numbered.selectExpr(
        "event_id",
        "k",
        "n",
        "ts",
        f"{endpoint} AS endpoint",
        "CASE WHEN event_type = 'error' AND k >= 90 THEN 500 ELSE 200 END AS http_status",
        f"{body} AS body",
    )


def envelopes(t: Mapping, run_id: str = RUN) -> DataFrame:
    """The payloads as envelopes; the event id names the file, the day is the batch.

    The body is exploded from a list of one: a filter on anything in it then stays above, where a plain column would be
    replaced by its expression and each condition would build and parse the text again.
    """
    staged = payloads(t).withColumn("body", F.explode_outer(F.array(V.body(F.col("body")))))
    return staged.select(
        "endpoint",
        routing.entity_of(F.col("endpoint")).alias("entity"),
        "http_status",
        F.create_map(F.lit("run_id"), F.lit(run_id)).alias("request_params"),
        "body",
        F.lit(run_id).alias("run_id"),
        F.date_format("ts", "yyyyMMdd").alias("batch_id"),
        F.format_string("%012d.json", "event_id").alias("source_file"),
        F.col("ts").alias("load_ts"),
    )
