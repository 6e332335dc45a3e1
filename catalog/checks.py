"""One query per check primitive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query
from catalog import sql as S
from dqloom.functions import rules as R
from dqloom.operators import checks as C
from dqloom.operators import fusion, keys
from dqloom.operators.checks import Check, Ref
from dqloom.plans import suites, testbed
from dqloom.plans.tables import MATCH_STATUSES


def verdict(check: Check, tables) -> DataFrame:
    return fusion.evaluate("single", "T", [check], tables).select("check_name", "status", "rows_failed")


def single(name: str, check: Check, ctes: str, count_sql: str):
    """A query that evaluates one check on the defective entity tables."""
    query(name, S.verdicts(ctes, {check.name: count_sql}))(lambda t: verdict(check, testbed.entity_tables(t, True)))


single(
    "chk_null_home_away",
    C.rows_where("missing_home_away", "matches", R.any_null("home_team_id", "away_team_id")),
    S.X_MATCH,
    S.count("x_match", "home_team_id IS NULL OR away_team_id IS NULL"),
)
single(
    "chk_range_matchday",
    C.rows_where("matchday_range", "matches", R.outside("matchday", 0, 60)),
    S.X_MATCH,
    S.count("x_match", "matchday < 0 OR matchday > 60"),
)
single(
    "chk_set_status",
    C.rows_where("status_set", "matches", R.not_in("status", MATCH_STATUSES)),
    S.X_MATCH,
    S.count("x_match", f"status NOT IN {S.STATUSES}"),
)
single(
    "chk_pred_same_team",
    C.rows_where("same_team", "matches", R.same("home_team_id", "away_team_id")),
    S.X_MATCH,
    S.count("x_match", "home_team_id = away_team_id"),
)
single(
    "chk_uniq_present_ids",
    C.duplicate_groups("unique_present", "matches", "id", count_null_keys=False),
    S.X_MATCH,
    S.duplicates("x_match", "id", "id IS NOT NULL"),
)
single(
    "chk_uniq_with_nulls",
    C.duplicate_groups("unique_all", "matches", "id"),
    S.X_MATCH,
    S.duplicates("x_match", "id"),
)
single(
    "chk_fk_competition",
    C.orphans("competition_fk", "matches", suites.COMPETITION),
    S.ENTITIES,
    S.orphans("x_match", "competition_id", "x_competition", null_counts=True),
)
single(
    "chk_fk_all",
    C.orphans("all_fks", "matches", suites.COMPETITION, suites.HOME, suites.AWAY),
    S.ENTITIES,
    "SELECT ("
    + ") + (".join(
        (
            S.orphans("x_match", "competition_id", "x_competition", null_counts=True),
            S.orphans("x_match", "home_team_id", "x_team"),
            S.orphans("x_match", "away_team_id", "x_team"),
        )
    )
    + ")",
)
single(
    "chk_rate_standings",
    C.rows_where("win_rate", "standings", R.ratio_outside("won", "playedGames", 0, 0.5)),
    S.X_STANDING,
    S.count("x_standing", "playedGames <> 0 AND won * 1.0 / playedGames > 0.5"),
)
single(
    "chk_points_consistency",
    C.rows_where("points", "standings", suites.POINTS),
    S.X_STANDING,
    S.count("x_standing", "points <> won * 3 + draw"),
)
single(
    "chk_zero_games",
    C.rows_where("zero_games", "standings", "playedGames = 0 OR won + draw = 0"),
    S.X_STANDING,
    S.count("x_standing", "playedGames = 0 OR won + draw = 0"),
)
single(
    "chk_negative",
    C.rows_where("negative", "standings", R.negative("points", "goalDifference")),
    S.X_STANDING,
    S.count("x_standing", "points < 0 OR goalDifference < 0"),
)
single(
    "chk_sentinel_name",
    C.rows_where("sentinel", "competitions", R.equals("name", "NATION_7")),
    S.ENTITIES,
    S.count("x_competition", "name = 'NATION_7'"),
)
single(
    "chk_dates_missing",
    C.rows_where("dates_missing", "matches", R.any_null("utcDate")),
    S.X_MATCH,
    S.count("x_match", "utcDate IS NULL"),
)
single("chk_nonempty", C.not_empty("teams_not_empty", "teams"), S.ENTITIES, S.empty("x_team"))


def table_check(name: str, check: Check, count_sql: str):
    """A query that evaluates one check directly on the benchmark tables."""
    query(name, S.verdicts("", {check.name: count_sql}))(lambda t: verdict(check, {n: t[n] for n in check.tables()}))


table_check(
    "chk_source_completeness",
    C.all_loaded("orders_with_lines", "orders", ("o_orderkey",), "lineitem", ("l_orderkey",)),
    "SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
table_check(
    "chk_source_exclusivity",
    C.none_invented("documents_labelled", "documents", ("doc_id",), "labels", ("doc_id",)),
    "SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
table_check(
    "chk_source_composite",
    C.all_loaded("turns_answered", "conversations", ("conv_id", "role"), "events", ("user_id", "event_type")),
    "SELECT count(*) FROM (SELECT DISTINCT conv_id, role FROM conversations) c WHERE NOT EXISTS "
    "(SELECT 1 FROM events e WHERE e.user_id = c.conv_id AND e.event_type = c.role)",
)
table_check(
    "chk_text_dupes",
    C.duplicate_groups("text_unique", "documents", "text", wide=True),
    S.duplicates("documents", "text"),
)
table_check(
    "chk_label_fk",
    C.orphans("label_document_fk", "labels", Ref("document", ("doc_id",), "documents", ("doc_id",))),
    S.orphans("labels", "doc_id", "documents", "doc_id"),
)
table_check(
    "chk_order_customer_fk",
    C.orphans("order_customer_fk", "orders", Ref("customer", ("o_custkey",), "customer", ("c_custkey",))),
    S.orphans("orders", "o_custkey", "customer", "c_custkey"),
)
table_check(
    "chk_line_order_fk",
    C.orphans("line_order_fk", "lineitem", Ref("order", ("l_orderkey",), "orders", ("o_orderkey",))),
    S.orphans("lineitem", "l_orderkey", "orders", "o_orderkey"),
)
table_check(
    "chk_role_set",
    C.rows_where("role_set", "conversations", R.not_in("role", ("user", "assistant"))),
    S.count("conversations", "role NOT IN ('user', 'assistant')"),
)
table_check(
    "chk_turn_uniq",
    C.duplicate_groups("turn_unique", "conversations", "conv_id", "turn"),
    S.duplicates("conversations", "conv_id, turn"),
)


@query(
    "chk_source_summary",
    "SELECT CAST((SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) "
    "AS BIGINT) AS missing, CAST((SELECT count(DISTINCT o_orderkey) FROM orders) AS BIGINT) AS src_count",
)
def source_summary(t):
    return keys.unmatched_summary(t["orders"], ["o_orderkey"], t["lineitem"], ["l_orderkey"])


@query(
    "chk_ship_before_order",
    "SELECT CAST(count(*) AS BIGINT) AS early FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate",
)
def ship_before_order(t):
    lines = t["lineitem"].select("l_orderkey", "l_shipdate")
    dated = lines.join(t["orders"].select("o_orderkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
    return dated.selectExpr(f"count_if({R.reversed_period('o_orderdate', 'l_shipdate')}) AS early")


FAIL_ROWS = {
    "failrows_null": (
        C.rows_where("no_home", "matches", R.any_null("home_team_id"), show=("competition_id", "season_id", "away_team_id")),
        f"WITH {S.X_MATCH} SELECT competition_id, season_id, away_team_id FROM x_match WHERE home_team_id IS NULL",
    ),
    "failrows_range": (
        C.rows_where("matchday", "matches", suites.MATCHDAY, show=("id", "matchday")),
        f"WITH {S.X_MATCH} SELECT id, matchday FROM x_match WHERE matchday < 0 OR matchday > 60",
    ),
    "failrows_uniq": (
        C.duplicate_groups("unique", "matches", "id"),
        f"WITH {S.X_MATCH} SELECT id, count(*) AS cnt FROM x_match GROUP BY id HAVING count(*) > 1",
    ),
    "failrows_fk": (
        C.orphans("fks", "matches", suites.COMPETITION, suites.HOME, suites.AWAY, show=("id",)),
        f"""WITH {S.ENTITIES}
        SELECT 'competition' AS ref_type, m.id FROM x_match m LEFT JOIN x_competition c ON c.id = m.competition_id WHERE c.id IS NULL
        UNION ALL SELECT 'home_team', m.id FROM x_match m LEFT JOIN x_team t ON t.id = m.home_team_id
          WHERE m.home_team_id IS NOT NULL AND t.id IS NULL
        UNION ALL SELECT 'away_team', m.id FROM x_match m LEFT JOIN x_team t ON t.id = m.away_team_id
          WHERE m.away_team_id IS NOT NULL AND t.id IS NULL""",
    ),
}
for _name, (_check, _sql) in FAIL_ROWS.items():
    query(_name, _sql)(lambda t, check=_check: fusion.failing_rows(check, testbed.entity_tables(t, True)))


@query(
    "failrows_unmatched_keys",
    "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def failrows_unmatched_keys(t):
    check = C.all_loaded("lines", "orders", ("o_orderkey",), "lineitem", ("l_orderkey",))
    return fusion.failing_rows(check, {"orders": t["orders"], "lineitem": t["lineitem"]})


@query(
    "failrows_unmatched_rows",
    "SELECT doc_id, lang, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def failrows_unmatched_rows(t):
    check = C.none_invented("labels", "documents", ("doc_id",), "labels", ("doc_id",))
    return fusion.failing_rows(check, {"documents": t["documents"], "labels": t["labels"]}).select("doc_id", "lang", "source", "n_chars")


@query("failrows_text_dupes", "SELECT text, count(*) AS cnt FROM documents GROUP BY text HAVING count(*) > 1")
def failrows_text_dupes(t):
    check = C.duplicate_groups("text_unique", "documents", "text", wide=True)
    return fusion.failing_rows(check, {"documents": t["documents"]})


@query(
    "failrows_drill_down",
    f"WITH {S.X_STANDING} SELECT season_id, competition_id, team_id, points FROM x_standing WHERE points <> won * 3 + draw "
    "ORDER BY season_id, competition_id, team_id LIMIT 20",
)
def drill_down(t):
    check = C.rows_where("points", "standings", suites.POINTS, show=("season_id", "competition_id", "team_id", "points"))
    return fusion.drill_down(check, testbed.entity_tables(t, True), ["season_id", "competition_id", "team_id"])


@query(
    "quarantine_split",
    f"""WITH {S.X_MATCH}, v AS (SELECT
      CASE WHEN home_team_id IS NULL OR away_team_id IS NULL OR home_team_id = away_team_id THEN 1 ELSE 0 END AS teams,
      CASE WHEN matchday < 0 OR matchday > 60 THEN 1 ELSE 0 END AS matchday, CASE WHEN utcDate IS NULL THEN 1 ELSE 0 END AS date
      FROM x_match)
    SELECT CASE WHEN teams + matchday + date = 0 THEN 'accepted' ELSE 'quarantine' END AS fate,
      CASE WHEN teams = 1 THEN 'teams;' ELSE '' END || CASE WHEN matchday = 1 THEN 'matchday;' ELSE '' END ||
      CASE WHEN date = 1 THEN 'date;' ELSE '' END AS broken, count(*) AS rows FROM v GROUP BY ALL""",
)
def quarantine_split(t):
    constraints = [
        C.rows_where("teams;", "matches", f"{suites.NO_TEAM} OR {suites.SAME_TEAM}"),
        C.rows_where("matchday;", "matches", suites.MATCHDAY),
        C.rows_where("date;", "matches", R.any_null("utcDate")),
    ]
    split = fusion.split_by_constraints(testbed.matches(t, True), constraints)
    fate = "CASE WHEN size(violations) = 0 THEN 'accepted' ELSE 'quarantine' END AS fate"
    return split.selectExpr(fate, "array_join(violations, '') AS broken").groupBy("fate", "broken").agg(F.count(F.lit(1)).alias("rows"))
