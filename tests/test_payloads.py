"""Raw envelopes, flattening and payload validators."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dqloom.functions import routing
from dqloom.operators import flatten, mutations, schemas, structure
from dqloom.plans import native
from dqloom.sources import envelopes as E
from dqloom.sources import generated as G


def envelopes(spark, *bodies, endpoint="competitions/1/matches?season=2024", status=200):
    rows = [(endpoint, status, json.dumps(b) if not isinstance(b, str) else b, f"b{i}", f"{i}.json") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "endpoint STRING, http_status INT, body STRING, batch_id STRING, source_file STRING")
    routed = df.select(
        "*",
        routing.entity_of(F.col("endpoint")).alias("entity"),
        F.lit("r").alias("run_id"),
        F.create_map(F.lit("run_id"), F.lit("r")).alias("request_params"),
        F.current_timestamp().alias("load_ts"),
    )
    return E.text_envelopes(routed)


def match(i, **changes):
    team = {"id": i * 10, "name": "x"}
    base = {
        "id": i,
        "utcDate": "2024-03-01T12:00:00Z",
        "status": "FINISHED",
        "matchday": 1,
        "homeTeam": team,
        "awayTeam": {"id": i * 10 + 1, "name": "y"},
        "competition": {"id": 1},
        "season": {"id": 2024, "startDate": "2024-01-01", "endDate": "2024-12-31"},
        "score": {"winner": "DRAW", "fullTime": {"home": 1, "away": 1}},
    }
    return {k: v for k, v in {**base, **changes}.items() if v != "DROP"}


def rules(df, entity="matches"):
    return sorted((r["rule"], r["field"]) for r in structure.element_findings(df, [entity], ["schema"]).collect())


def statuses(df):
    return {r["check_name"]: (r["status"], r["rows_failed"], r["message"]) for r in native.payload_results(df).collect()}


def test_key_and_completeness_of_lists(spark):
    df = envelopes(spark, {}, {"matches": None}, {"matches": []})
    facts = native.envelope_facts(df)
    assert facts.filter("NOT has_key").count() == 1
    found = structure.payload_findings(df, ["matches"], ["completeness"])
    assert found.filter("rule = 'list_missing_or_empty'").count() == 3


def test_structure_tells_type_from_required(spark):
    assert rules(envelopes(spark, {"matches": [match(1)]})) == []
    assert rules(envelopes(spark, {"matches": [match(1, id="abc")]})) == [("type", "id")]
    assert rules(envelopes(spark, {"matches": [match(1, id="DROP")]})) == [("required", "id")]
    assert rules(envelopes(spark, {"matches": [match(1, id=None)]})) == [("type", "id")]
    assert rules(envelopes(spark, {"matches": [match(1, id=1.0)]})) == []
    assert rules(envelopes(spark, {"matches": [match(1, id=1.5)]})) == [("type", "id")]
    assert rules(envelopes(spark, {"matches": [match(1, homeTeam=None)]})) == [("type", "homeTeam")]
    assert rules(envelopes(spark, {"matches": [7]})) == [("type", "")]
    assert rules(envelopes(spark, {"matches": [match(1, matchday="3", stage=5)]})) == [("type", "matchday"), ("type", "stage")]


def test_minimum_lengths_and_nullable_objects(spark):
    areas = envelopes(spark, {"areas": [{"id": 1, "name": "", "countryCode": "X"}, {"id": 2, "name": "b", "countryCode": None}]}, endpoint="areas")
    assert rules(areas, "areas") == [("minLength", "countryCode"), ("minLength", "name")]
    comp = {"id": 1, "name": "c", "type": None, "plan": None, "currentSeason": None}
    assert rules(envelopes(spark, {"competitions": [comp]}, endpoint="competitions"), "competitions") == []
    bad = {**comp, "currentSeason": [1], "area": "x"}
    assert rules(envelopes(spark, {"competitions": [bad]}, endpoint="competitions"), "competitions") == [
        ("type", "area"),
        ("type", "currentSeason"),
    ]


def test_standings_tables(spark):
    row = {"team": {"id": 1}, "position": 1, "points": 3, "playedGames": 1}
    body = {"standings": [{"type": "TOTAL", "table": [row, {**row, "points": "3"}]}, {"type": "HOME", "table": []}, {"table": [row]}]}
    df = envelopes(spark, body, endpoint="competitions/1/standings?season=2024")
    found = structure.findings(df, ["schema"]).filter("rule <> 'duplicate_id'").collect()
    assert sorted((r["rule"], r["field"]) for r in found) == [("minItems", "table"), ("required", "type"), ("type", "points")]
    verdict = statuses(df)
    assert verdict["standings_schema"][0] == "WARN"
    assert verdict["standings_uniqueness"] == ("PASS", 0, "1 warnings")


@pytest.mark.parametrize("family", native.PAYLOAD_SUITES)
def test_families_can_run_alone(spark, generated, family):
    alone = {r["check_name"]: (r["status"], r["rows_failed"]) for r in native.payload_results(generated, [family]).collect()}
    assert set(alone) == set(native.PAYLOAD_SUITES[family])
    together = statuses(generated)
    assert alone == {name: together[name][:2] for name in alone}


def test_ids_are_compared_with_their_type(spark):
    mixed = [match(1, homeTeam={"id": 1}, awayTeam={"id": "1"}), 7, "x", match(1, id="1"), match(2, homeTeam={}, awayTeam={"id": None})]
    found = structure.findings(envelopes(spark, {"matches": mixed}), ["consistency", "uniqueness"]).collect()
    assert sorted((r["rule"], r["value"]) for r in found if r["level"] == "error") == [("same_team", "2")]
    twice = structure.findings(envelopes(spark, {"matches": [match(1, id="a"), match(2, id="a"), match(5)]}), ["uniqueness"]).collect()
    assert [(r["rule"], r["value"]) for r in twice] == [("duplicate_id", "a")]


def test_scorers(spark):
    body = {"scorers": [{"player": {"id": 1}, "team": {"id": 2}, "goals": 3}, {"player": {"id": 1}, "team": {}, "goals": None}, {"team": {}, "goals": 1}]}
    verdict = statuses(envelopes(spark, body, endpoint="competitions/1/scorers?season=2024"))
    assert verdict["scorers_schema"][:2] == ("WARN", 1)
    assert verdict["scorers_uniqueness"][:2] == ("FAIL", 1)
    assert verdict["scorers_consistency"] == ("PASS", 0, "1 warnings")
    assert verdict["areas_schema"][0] == "SKIP"


def test_consistency_of_matches(spark):
    season = {"id": 1, "startDate": "2024-12-31", "endDate": "2024-01-01"}
    items = [match(1, season=season), match(2, homeTeam="DROP", awayTeam="DROP"), match(3, utcDate="2030-01-01T00:00:00Z")]
    found = structure.element_findings(envelopes(spark, {"matches": items}), ["matches"], ["consistency"]).collect()
    got = sorted((r["position"], r["level"], r["rule"]) for r in found)
    assert ("0", "error", "period_reversed") in got
    assert ("1", "error", "same_team") in got
    assert ("2", "warning", "outside_season") in got


def test_bad_values_become_null_or_stop_a_strict_load(spark):
    df = envelopes(spark, {"matches": [match(1, id="abc"), match(2, matchday=""), match(3, utcDate="soon")]})
    loaded = {r["match_id"]: r for r in flatten.load_star(df, "d")["fact_match"].collect()}
    assert set(loaded) == {2, 3} and loaded[2]["matchday"] is None and loaded[3]["utc_date"] is None
    with pytest.raises(PySparkException):
        flatten.load_star(df, "d", strict=True)["fact_match"].collect()


def test_first_payload_wins_a_key(spark):
    df = envelopes(spark, {"matches": [match(1, status="FIRST"), match(1, status="LATER")]}, {"matches": [match(1, status="LAST")]})
    for parts in (1, 3):
        (row,) = flatten.load_star(df.repartition(parts), "d")["fact_match"].collect()
        assert row["status"] == "FIRST"


def test_offsets_and_defaults(spark):
    df = envelopes(spark, {"matches": [match(1, utcDate="2024-03-01T12:00:00+02:00")]})
    assert str(flatten.load_star(df, "d")["fact_match"].first()["utc_date"]) == "2024-03-01 12:00:00"
    assert str(flatten.load_entities(df)["matches"].first()["utcDate"]) == "2024-03-01 10:00:00"
    body = {"competition": {"id": 1}, "season": {"id": 2}, "standings": [{"type": "T", "table": [{"team": {"id": 5}}]}]}
    standing = flatten.load_entities(envelopes(spark, body, endpoint="competitions/1/standings"))["standings"].first()
    assert (standing["points"], standing["won"]) == (0, 0)
    assert flatten.load_star(envelopes(spark, body, endpoint="competitions/1/standings"), "d")["fact_standing"].first()["points"] is None


def test_generated_data_round_trips(spark, generated):
    star = flatten.load_star(generated, "d")
    sizes = {n: df.count() for n, df in star.items()}
    assert sizes == {
        "dim_area": 5, "dim_competition": 3, "dim_team": 24, "dim_season": 2,
        "fact_match": 228, "fact_match_score": 228, "fact_standing": 48,
    }
    raw = G.payloads(spark, G.PRESETS["small"])
    (row,) = G.manifest(raw).collect()
    assert (row["files"], row["matches"], row["standings"]) == (20, 228, 6)
    again = G.payloads(spark, G.PRESETS["small"])
    assert raw.drop("request_params").exceptAll(again.drop("request_params")).count() == 0
    assert raw.select("response_json").exceptAll(G.payloads(spark, G.PRESETS["small"], seed=7).select("response_json")).count() > 0


def test_medium_preset_size(spark):
    totals = G.manifest(G.payloads(spark, G.PRESETS["medium"])).agg(F.sum("matches"), F.count("*")).first()
    assert tuple(totals) == (15200, 4)


def test_file_layouts(spark, tmp_path):
    body = {"endpoint": "areas", "response_json": {"areas": [{"id": 1, "name": "a"}]}, "request_params": {"dag_id": "d"}}
    for age, folder in enumerate(("run/batch_001", "run/batch_007", "flat")):
        target = tmp_path / folder / "payloads"
        target.mkdir(parents=True)
        (target / "000001_areas.json").write_text(json.dumps(body, indent=2))
        os.utime(target / "000001_areas.json", (1_700_000_000 + age, 1_700_000_000 + age))
    found = E.read_envelopes(spark, str(tmp_path / "run"), "r1").orderBy("batch_id").collect()
    assert [r["batch_id"] for r in found] == ["r1_b0001", "r1_b0002"]
    assert found[0]["http_status"] == 200 and found[0]["source_file"] == "000001_areas.json"
    assert found[0]["request_params"] == {"dag_id": "d", "run_id": "r1", "batch_id": "r1_b0001", "source_file": "000001_areas.json"}
    (flat,) = E.read_envelopes(spark, str(tmp_path / "flat"), "r2").collect()
    assert flat["batch_id"] == "r2_b0001"
    with pytest.raises(FileNotFoundError):
        E.read_envelopes(spark, str(tmp_path / "nothing"), "r3")
    assert E.newest_run_folder(spark, str(tmp_path)).endswith("/flat")


def test_spark_written_batches(spark, tmp_path):
    G.write_payloads(G.payloads(spark, G.PRESETS["medium"]), str(tmp_path / "ds"))
    found = E.read_envelopes(spark, str(tmp_path / "ds"), "m", lines=True)
    assert found.count() == 122
    assert sorted(r[0] for r in found.select("batch_id").distinct().collect()) == [f"m_b000{i}" for i in range(1, 5)]


def test_payload_mutations_hit_the_first_element_only(spark):
    df = envelopes(spark, {"matches": [match(1), match(2)], "count": 2})

    def mutated(action, n=5):
        return json.loads(mutations.mutate_payloads(df, "matches", action, n, "s").select(F.to_json("body")).first()[0])

    assert mutated("duplicate_first")["matches"] == [match(1), match(2), match(1)]
    assert mutated("drop_required")["matches"] == [match(1, id="DROP"), match(2)]
    assert mutated("corrupt_id")["matches"][0]["id"] == "abc"
    assert mutated("matchday_out_of_range")["matches"][0]["matchday"] == "999"
    assert mutated("drop_matches_key") == {"count": 2}
    assert mutated("unknown") == {"matches": [match(1), match(2)], "count": 2}
    one = mutated("swap_teams", 1)["matches"]
    swapped = [m for m in one if m["homeTeam"]["id"] % 10 == 1]
    assert len(swapped) == 1 and mutated("swap_teams", 1)["matches"] == one
    assert all(m["homeTeam"]["id"] % 10 == 1 for m in mutated("swap_teams", 9)["matches"])
    untouched = envelopes(spark, {"matches": []}, {})
    bodies = [r[0] for r in mutations.mutate_payloads(untouched, "matches", "corrupt_id").select(F.to_json("body")).collect()]
    assert sorted(bodies) == ['{"matches":[]}', "{}"]


def test_gates_stop_at_the_first_failure(spark, generated):
    rows, stopped = native.run_gates(native.staging_gates(generated), enforce=False)
    assert stopped is None and {r["suite"] for r in rows} == {"ingestion", *native.PAYLOAD_SUITES}
    nameless = F.parse_json(F.lit('{"competitions": [{"name": "no id"}]}'))
    broken = generated.withColumn("body", F.when(F.col("entity") == "competitions", nameless).otherwise(F.col("body")))
    rows, stopped = native.run_gates(native.staging_gates(broken), enforce=False)
    assert stopped == "schema" and {r["suite"] for r in rows} == {"ingestion", "schema"}
    with pytest.raises(native.GateFailed, match="competitions_schema"):
        native.run_gates(native.staging_gates(broken))
    star = flatten.load_star(generated, "d")
    rows, stopped = native.run_gates(native.star_gates(star, generated), enforce=False)
    assert stopped is None and len(rows) == 15


def test_copy_run_keeps_good_payloads_with_their_list(spark):
    good, bad = envelopes(spark, {"matches": [match(1)]}, {"other": 1}), envelopes(spark, {"matches": []}, status=500)
    copied = E.copy_run(good.unionByName(bad), "r", "exp_1")
    (row,) = copied.collect()
    assert row["run_id"] == "exp_1" and row["request_params"] == {"run_id": "exp_1", "source_run_id": "r"}


# -- schema documents ----------------------------------------------------------------------------------------------

ORDERS = {
    "$schema": "http://json-schema.org/draft-07/schema#",
    "definitions": {
        "code": {"type": "string", "pattern": "^[A-Z]{2}[0-9]+$", "maxLength": 6},
        "line": {
            "type": "object",
            "required": ["code", "count"],
            "properties": {
                "code": {"$ref": "#/definitions/code"},
                "count": {"type": "integer", "minimum": 1, "exclusiveMaximum": 100},
                "tags": {"type": "array", "uniqueItems": True, "items": {"enum": ["a", "b", 3, None]}},
                "price": {"anyOf": [{"type": "number", "multipleOf": 0.05}, {"type": "array", "items": {"type": "number"}}]},
            },
            "additionalProperties": False,
        },
    },
    "type": "object",
    "properties": {
        "matches": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "array", "items": {"$ref": "#/definitions/line"}}},
        "kind": {"const": "order"},
        "one": {"oneOf": [{"type": "integer"}, {"type": "number", "minimum": 5}]},
        "no": {"not": {"type": "null"}},
        "holds": {"type": "array", "contains": {"type": "string"}},
    },
    "required": ["matches"],
}


def _broken(spark, *bodies, document=ORDERS):
    found = schemas.findings(envelopes(spark, *bodies), {"matches": document})
    return sorted((r["payload"][1], r["place"], r["field"], r["rule"]) for r in found.collect())


def test_a_document_of_lists_in_lists(spark):
    good = {"code": "AB1", "count": 1, "tags": ["a", 3, None], "price": 0.15}
    lines = [
        {"code": "ab1", "count": 0, "price": [1, 2.5]},
        {"code": "AB123456", "count": 100, "price": [1, "x"]},
        {"count": 1.0, "more": 1, "tags": ["a", "a", "c"], "price": 0.01},
        7,
        {"code": None, "count": 1.5, "price": None},
    ]
    line = "matches[][]"
    assert _broken(spark, {"matches": [[good], lines], "kind": "order", "one": 2, "no": 1, "holds": [1, "x"]}) == sorted(
        [
            ("0", "1/0", f"{line}.code", "pattern"),
            ("0", "1/0", f"{line}.count", "minimum"),
            ("0", "1/1", f"{line}.code", "maxLength"),
            ("0", "1/1", f"{line}.count", "exclusiveMaximum"),
            ("0", "1/1", f"{line}.price", "anyOf"),
            ("0", "1/2", f"{line}.code", "required"),
            ("0", "1/2", line, "additionalProperties"),
            ("0", "1/2", f"{line}.tags", "uniqueItems"),
            ("0", "1/2/2", f"{line}.tags[]", "enum"),
            ("0", "1/2", f"{line}.price", "anyOf"),
            ("0", "1/3", line, "type"),
            ("0", "1/4", f"{line}.code", "type"),
            ("0", "1/4", f"{line}.count", "type"),
            ("0", "1/4", f"{line}.price", "anyOf"),
        ]
    )


def test_documents_judge_the_payload_itself(spark):
    bodies = [[], {"matches": []}, {"matches": [[], [], []], "kind": "x", "one": 7, "no": None, "holds": [1]}, {"matches": None}, "no json", {"matches": [3]}]
    assert _broken(spark, *bodies) == [
        ("0", "", "", "type"),
        ("1", "", "matches", "minItems"),
        ("2", "", "holds", "contains"),
        ("2", "", "kind", "const"),
        ("2", "", "matches", "maxItems"),
        ("2", "", "no", "not"),
        ("2", "", "one", "oneOf"),
        ("3", "", "matches", "type"),
        ("5", "0", "matches[]", "type"),
    ]
    assert _broken(spark, {"matches": []}, document=True) == [] and _broken(spark, {"a": 1}, document=False) == [("0", "", "", "false")]
    assert schemas.findings(envelopes(spark, {"matches": []}), {}).count() == 0


@pytest.mark.parametrize(
    "document",
    [{"if": {}}, {"patternProperties": {}}, {"$ref": "#"}, {"$ref": "http://x/y"}, {"type": "text"}, {"enum": [[1]]}, {"properties": {'a"': True}}],
)
def test_what_a_document_may_not_say(document):
    with pytest.raises(ValueError):
        schemas.compiled({"properties": {"a": document}})


def test_documents_find_what_the_structure_checks_find(spark, tmp_path):
    bad = {"count": "1", "filters": 3, "matches": [match(1, matchday="x", season=None), match(2, id="2", homeTeam={"id": 1.5, "name": 3}), 5]}
    bodies = envelopes(spark, {"matches": [match(1)]}, bad, {"count": 1})
    old = structure.findings(bodies, families=["schema"]).where("level = 'error' AND rule <> 'list_missing'")
    for name, document in schemas.documents().items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    new = schemas.findings(bodies, schemas.read_documents(spark, str(tmp_path)))
    shown = F.regexp_replace("field", r"^.*\[\][.]?", "")
    wanted = sorted((r[0], r[1] or "", r[2], r[3]) for r in old.select("payload", "position", "field", "rule").collect())
    assert sorted(tuple(r) for r in new.select("payload", "place", shown, "rule").collect()) == wanted and len(wanted) > 6
