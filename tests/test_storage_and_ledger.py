"""Run control, stored tables, exports and streaming."""

import datetime as dt
import json
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom import session
from dqloom.operators import checks as C
from dqloom.operators import flatten, fusion, ledger, reports
from dqloom.plans import suites, testbed
from dqloom.sources import envelopes as E
from dqloom.sources import generated as G
from dqloom.sources import tables
from dqloom.streaming import incremental


def events(spark, *rows):
    start = dt.datetime(2024, 1, 1)
    data = [("dag", run, parent, layer, status, None, start + dt.timedelta(minutes=i), i) for i, (layer, parent, run, status) in enumerate(rows)]
    return spark.createDataFrame(data, ledger.BATCH_EVENT_SCHEMA)


def test_batch_state_machine(spark):
    steps = ("NEW", "PROCESSING", "FAILED", "PROCESSING", "SUCCESS")
    state = ledger.batch_state(events(spark, *[("STG", "s1", "s1", s) for s in steps]))
    (row,) = state.collect()
    assert (row["status"], row["attempts"]) == ("SUCCESS", 2)
    assert row["created_at"] == dt.datetime(2024, 1, 1) and row["last_updated_at"] == dt.datetime(2024, 1, 1, 0, 4)


@pytest.fixture(scope="module")
def state(spark):
    return ledger.batch_state(
        events(
            spark,
            ("STG", "s1", "s1", "SUCCESS"),
            ("DDS", "s1", "d1", "SUCCESS"),
            ("DDS", "s1", "d2", "SUCCESS"),
            ("STG", "s1", "exp_a", "SUCCESS"),
            ("STG", "s1", "exp_b", "FAILED"),
            ("DDS", "exp_a", "exp_da", "SUCCESS"),
            ("DDS", "s1", "exp_da", "SUCCESS"),
            ("DDS", "s1", "exp_d1", "SUCCESS"),
            ("STG", "s9", "s9", "SUCCESS"),
            ("DDS", "s9", "d9", "FAILED"),
            ("T_SODA", "s1", "d2", "SUCCESS"),
        )
    )


def test_pending_loads(state):
    assert [r[0] for r in ledger.pending_loads(state).collect()] == ["s9"]
    (claim,) = ledger.claim_events(state, "dag", "d10").collect()
    assert (claim["run_id"], claim["parent_run_id"], claim["status"]) == ("d10", "s9", "NEW")


def test_stage_targets(state):
    def runs(**options):
        return [(r["run_id"], r["kind"]) for r in ledger.stage_targets(state, baseline_stg="s1", **options).collect()]

    assert runs(stage="E", only_unprocessed=False) == [("s1", "baseline"), ("exp_a", "experiment"), ("exp_b", "experiment")]
    assert runs(stage="T", only_unprocessed=False) == [("d2", "baseline"), ("exp_da", "experiment"), ("exp_d1", "experiment")]
    assert runs(stage="T", processed_layer="T_SODA") == [("exp_da", "experiment"), ("exp_d1", "experiment")]
    assert runs(stage="L", baseline_dds="d1", include_experiments=False, only_unprocessed=False) == [("d1", "baseline")]
    with pytest.raises(ValueError):
        ledger.stage_targets(state, "X", "s1")


def test_post_targets_and_related_runs(state):
    found = [(r["dds_run_id"], r["stg_run_id"]) for r in ledger.post_targets(state, only_unprocessed=False).collect()]
    # The newest self-parented staging run is the baseline.
    assert found == []
    found = {(r["dds_run_id"], r["stg_run_id"]) for r in ledger.post_targets(state, "s1", only_unprocessed=False).collect()}
    assert found == {("d2", "s1"), ("exp_da", "exp_a"), ("exp_d1", "s1")}
    assert [r[0] for r in ledger.related_runs(state, "s1", "d1").collect()] == ["d1", "d2", "exp_a", "exp_b", "exp_d1", "exp_da", "s1"]


def test_run_events_merge_like_an_update(spark):
    rows = [("v", 1, "PROCESSING", None, 0), ("v", 2, "SUCCESS", 120, None)]
    merged = ledger.merge_run_events(spark.createDataFrame(rows, "validation_run_id STRING, seq INT, status STRING, duration_ms INT, failed INT"))
    (row,) = merged.collect()
    assert (row["status"], row["duration_ms"], row["failed"]) == ("SUCCESS", 120, 0)


def test_audit_rows(spark):
    rows = [("SUCCESS", 5, None), ("STARTED", 5, None), ("FAILED", 5, dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "status STRING, rows_processed BIGINT, finished_at TIMESTAMP_NTZ")
    got = {r["status"]: r for r in ledger.audit_rows(df.withColumn("started_at", F.lit(None).cast("timestamp_ntz"))).collect()}
    assert got["SUCCESS"]["rows_processed"] == 5 and got["SUCCESS"]["finished_at"] is not None
    assert got["STARTED"]["rows_processed"] is None and got["STARTED"]["finished_at"] is None
    assert got["FAILED"]["finished_at"] == dt.datetime(2024, 1, 1)


def test_runs_are_stored_side_by_side(spark, generated, tmp_path):
    root = str(tmp_path / "star")
    for run in ("d1", "d2"):
        tables.save_run(flatten.load_star(generated, run), root, run)
    one = tables.read_run(spark, root, ["fact_match", "dim_team"], "d1")
    assert one["fact_match"].count() == 228 and one["dim_team"].count() == 24
    plan = one["fact_match"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    late = flatten.load_star(generated, "d1")["dim_team"]
    tables.append_absent(spark, f"{root}/dim_team", late.unionByName(late.withColumn("team_id", F.col("team_id") + 10**6)), ["run_id", "team_id"])
    assert tables.read_run(spark, root, ["dim_team"], "d1")["dim_team"].count() == 48


def test_managed_tables(spark, small):
    spark.sql("CREATE DATABASE IF NOT EXISTS checks_db")
    entities = testbed.entity_tables(small)
    tables.save_entities({"areas": entities["areas"], "competitions": entities["competitions"]}, "checks_db")
    assert tables.entity_tables(spark, "checks_db", ["areas"])["areas"].count() == 5
    spark.range(3).selectExpr("id", "concat('r', id) AS run_id").write.partitionBy("run_id").saveAsTable("checks_db.versions")
    tables.delete_run(spark, ["checks_db.versions"], "r1")
    assert sorted(r["run_id"] for r in spark.table("checks_db.versions").collect()) == ["r0", "r2"]
    spark.sql("DROP DATABASE checks_db CASCADE")


def test_envelope_store_prunes_runs_and_entities(spark, generated, tmp_path):
    path = str(tmp_path / "raw")
    tables.append_envelopes(generated, path)
    stored = tables.read_envelopes(spark, path, "gen")
    assert stored.count() == 20
    plan = flatten.items(stored, "matches")._jdf.queryExecution().executedPlan().toString()
    assert "entity" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert flatten.load_star(stored, "d")["fact_match"].count() == 228


def test_export(spark, generated, tmp_path):
    exported = tables.export_payloads(generated, "gen")
    assert exported.count() == 20
    manifest = {(r["section"], r["name"]): r["payloads"] for r in tables.export_manifest(exported).collect()}
    assert manifest["total", "all"] == 20 and manifest["entity", "matches"] == 6 and manifest["season", "2023"] == 9
    assert manifest["competition_id", "2001"] == 6
    tables.write_export(exported, str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export")).count() == 20
    assert E.main_run(generated).first()["run_id"] == "gen"


def test_reports_are_written(spark, small, tmp_path):
    from dqloom.operators import fusion

    found = fusion.evaluate("soda", "T", suites.SODA.checks("T"), testbed.entity_tables(small)).withColumn("run_id", F.lit("r"))
    tables.write_reports(reports.report_documents(found, F.lit(1.5)), str(tmp_path / "reports"))
    (line,) = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "reports")).select("value").collect()]
    assert line["checks_total"] == 5 and line["spark_sec"] == 1.5 and len(line["results"]) == 5
    assert set(line["results"][0]) == {"check", "status", "failed_rows"}
    now = dt.datetime(2024, 1, 1)
    run = spark.createDataFrame(
        [("dag", "T_SODA", "soda", None, 100, 5, 2, '{"resources":{"cpu_percent_avg":"1.5","rss_kb":""}}', now, now)],
        "dag_id STRING, layer STRING, tool STRING, kind STRING, duration_ms INT, checks_total INT, checks_failed INT, meta_json STRING, "
        "started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ",
    )
    tables.write_summary(run, "dag", str(tmp_path / "summary"))
    (row,) = spark.read.option("header", True).csv(str(tmp_path / "summary")).collect()
    assert tuple(row.asDict()) == reports.SUMMARY_COLUMNS
    assert (row["stage"], row["kind"], row["avg_cpu_percent"], row["std_duration_ms"], row["avg_rss_kb"]) == ("T", "unknown", "1.5", "0.0", None)


def test_ledger_dump_and_rewrite(spark, tmp_path):
    rows = events(spark, ("STG", "s1", "s1", "NEW"), ("DDS", "s1", "d1", "NEW"), ("DDS", "s2", "d2", "NEW"))
    tables.append_ledger(rows, str(tmp_path / "ledger"))
    stored = spark.read.parquet(str(tmp_path / "ledger"))
    tables.write_ledger_dump({"batch": stored}, ledger.related_runs(ledger.batch_state(stored), "s1", "d1"), str(tmp_path / "dump"))
    assert spark.read.json(str(tmp_path / "dump/batch")).count() == 2
    tables.rewrite_ledger(ledger.without_runs(stored, "DDS", ["d2"]), str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 2


def test_streaming_takes_each_file_once(spark, tmp_path):
    folder, raw, found, memory = (str(tmp_path / n) for n in ("in", "raw", "results", "checkpoint"))
    payloads = G.payloads(spark, G.PRESETS["medium"])

    def arrive(no):
        body = payloads.filter(f"batch_no = {no}").withColumn("response_json", F.parse_json("response_json"))
        body.drop("batch_no").write.json(f"{folder}/batch_{no:03d}/payloads")

    def run():
        stream = incremental.arriving_envelopes(spark, folder, "r", lines=True)
        incremental.stage_and_check(stream, raw, found, memory).awaitTermination()

    arrive(1)
    run()
    first = spark.read.parquet(raw).count()
    arrive(2)
    run()
    run()
    stored = incremental.stored_envelopes(spark, raw)
    assert first == 32 and stored.count() == 62
    assert sorted(r[0] for r in stored.select("batch_id").distinct().collect()) == ["r_batch_001", "r_batch_002"]
    results = spark.read.parquet(found)
    assert results.filter("check_name = 'stg_missing_match_id'").count() == 2
    assert results.filter("status <> 'PASS'").count() == 0


def test_state_from_a_snapshot_and_its_tail(spark, tmp_path):
    """The same state as from all events, whenever it is compacted; folded events are not read again."""
    import random

    from dqloom.sources.history import History

    draw, start = random.Random(3), dt.datetime(2024, 1, 1)
    past, every = History(spark, str(tmp_path / "ledger")), []
    assert past.state().count() == 0 and past.compact() == -1
    for step in range(5):
        rows = [
            ("dag", f"r{draw.randrange(6)}", "p", draw.choice(["STG", "DDS"]), draw.choice(["NEW", "PROCESSING", "SUCCESS", "FAILED"]), draw.choice([None, "e"]),
             start + dt.timedelta(minutes=draw.randrange(400)), 100 * step + i)
            for i in range(20)
        ]
        every += rows
        past.append(spark.createDataFrame(rows, ledger.BATCH_EVENT_SCHEMA).coalesce(1))
        if step in (0, 1, 3):
            past.compact()
        whole = ledger.batch_state(spark.createDataFrame(every, ledger.BATCH_EVENT_SCHEMA))
        columns = whole.columns
        assert sorted(map(repr, past.state().select(columns).collect())) == sorted(map(repr, whole.collect()))
    read = past.state().inputFiles()
    assert any("snapshot-" in f for f in read) and not any("generation-0/" in f or "generation-1/" in f for f in read)
    before = len(past.state().inputFiles())
    for _ in range(3):
        past.append(spark.createDataFrame(every[:3], ledger.BATCH_EVENT_SCHEMA).coalesce(1))
        past.compact()
    assert len([f for f in past.state().inputFiles() if "generation-" in f]) <= before


def test_keys_that_come_back_in_a_later_batch(spark, tmp_path):
    """Keyed state over restarts: each repeated key once, in the batch that brings its second row."""
    from dqloom.streaming import repeats

    source, keys, memory = (str(tmp_path / n) for n in ("in", "keys", "checkpoint"))
    totals, read = {}, {}

    def arrive(rows):
        spark.createDataFrame(rows, "id STRING, part INT").coalesce(2).write.mode("append").parquet(source)

    def judge(epoch, found):
        totals[epoch] = found.count()
        read[epoch] = len(found.inputFiles())

    def run():
        stream = spark.readStream.schema("id STRING, part INT").parquet(source)
        repeats.watch(repeats.repeated(stream, ["id", "part"], False), keys, memory, judge).awaitTermination()

    arrive([("a", 1), ("b", 1), ("a", 2), (None, 1), (None, 1)])
    run()
    arrive([("a", 1), ("c", 1), ("c", 1), ("c", 1)])
    run()
    run()
    arrive([("a", 1), ("c", 1), ("b", 1)] + [("hot", 0)] * 5000)
    run()
    assert sorted(map(tuple, spark.read.parquet(keys).select("id", "part").collect())) == [("a", 1), ("b", 1), ("c", 1), ("hot", 0)]
    assert [totals[e] for e in sorted(totals)] == [0, 2, 4]
    # only keys that repeat are stored, not what was seen
    assert spark.read.parquet(keys).count() == 4


def test_repeated_ids_across_arriving_files(spark, tmp_path):
    folder, raw, found, memory = (str(tmp_path / n) for n in ("in", "raw", "results", "checkpoint"))

    def arrive(no, ids):
        (tmp_path / "in" / f"batch_{no:03d}" / "payloads").mkdir(parents=True)
        body = {"endpoint": "competitions/1/matches", "http_status": 200, "response_json": {"matches": [{"id": i, "matchday": 1} for i in ids]}}
        (tmp_path / "in" / f"batch_{no:03d}" / "payloads" / f"p{no}.json").write_text(json.dumps(body))

    def run():
        incremental.stage_and_check(incremental.arriving_envelopes(spark, folder, "r"), raw, found, memory).awaitTermination()
        rows = spark.read.parquet(found).filter("check_name = 'stg_duplicate_match_id'").select("epoch", "status", "rows_failed").collect()
        return [tuple(r)[1:] for r in sorted(rows)]

    arrive(1, [1, 2, 3])
    assert run() == [("PASS", 0)]
    arrive(2, [4, 2, None])
    assert run() == [("PASS", 0), ("FAIL", 1)]
    arrive(3, [2, 4, 5, 5])
    assert run() == run() == [("PASS", 0), ("FAIL", 1), ("FAIL", 3)]
    assert incremental.stored_envelopes(spark, raw).count() == 3


def test_checkpoint_folder_is_read_from_the_session(spark):
    assert session.cut_lineage(spark.range(5)).count() == 5
    assert "shared-checkpoints" in session.checkpoint_folder(spark)


def test_pending_runs_are_loaded_once(spark, generated, tmp_path):
    from dqloom.plans import loading

    raw, root = str(tmp_path / "raw"), str(tmp_path / "star")
    loading.staged(generated, raw, root, "dag", "gen")
    stored = tables.read_envelopes(spark, raw)
    assert [r["run_id"] for r in loading.load_pending(stored, root, "dag", "d1").collect()] == ["gen"]
    assert loading.load_pending(stored, root, "dag", "d2").collect() == []
    assert tables.read_run(spark, root, ["fact_match"], "d1")["fact_match"].count() == 228
    audit = spark.read.parquet(loading.audit_path(root))
    rows = {r["entity_name"]: r["rows_processed"] for r in audit.filter("status = 'SUCCESS'").collect()}
    assert rows["fact_match"] == 228 and rows["dim_team"] == 24 and rows["ALL"] is None
    state = ledger.batch_state(spark.read.parquet(loading.events_path(root)))
    assert {(r["layer"], r["run_id"]): (r["status"], r["attempts"]) for r in state.collect()} == {
        ("STG", "gen"): ("SUCCESS", 1),
        ("DDS", "d1"): ("SUCCESS", 1),
    }


def test_loading_a_run_again_adds_nothing(spark, generated, tmp_path):
    from dqloom.plans import loading

    root = str(tmp_path / "star")
    first = loading.load_run(generated, root, "dag", "d1")
    assert first["fact_match"] == 228
    assert set(loading.load_run(generated, root, "dag", "d1").values()) == {0}
    assert loading.load_run(generated, root, "dag", "d2") == first
    stored = spark.read.parquet(f"{root}/fact_match").groupBy("run_id").count().collect()
    assert {tuple(r) for r in stored} == {("d1", 228), ("d2", 228)}


def test_rows_without_a_key(spark, tmp_path):
    from pyspark.errors import PySparkException

    from dqloom.plans import loading

    body = json.dumps({"areas": [{"id": 1, "name": "a"}, {"name": "b"}, {"id": "x", "name": "c"}]})
    raw = spark.createDataFrame([("areas", 200, None, None, "b1", "f1")], "endpoint STRING, http_status INT, request_params MAP<STRING,STRING>, response_json VARIANT, batch_id STRING, source_file STRING")
    envelopes = E.as_envelopes(raw.withColumn("response_json", F.parse_json(F.lit(body))), "r")
    assert flatten.unkeyed_rows(envelopes, "r")["dim_area"].count() == 2
    assert loading.load_run(envelopes, str(tmp_path / "a"), "dag", "r")["dim_area"] == 1
    audit = spark.read.parquet(loading.audit_path(str(tmp_path / "a"))).filter("status = 'REJECTED'").collect()
    assert [(r["entity_name"], r["message"]) for r in audit] == [("dim_area", "2 rows without a key")]
    with pytest.raises(PySparkException):
        loading.load_run(envelopes, str(tmp_path / "b"), "dag", "r", strict=True)


def test_broken_payloads_fail_the_batch(spark, tmp_path):
    from dqloom.plans import loading

    sound = json.dumps({"endpoint": "areas", "response_json": {"areas": [{"id": 1}]}})
    files = {"batch_001/payloads/a.json": sound, "batch_001/payloads/b.json": sound[:20], "batch_002/payloads/c.json": "[1]", "batch_002/payloads/d.json": " "}
    for name, text in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    (tmp_path / "in" / "batch_003").mkdir()
    folder, root = str(tmp_path / "in"), str(tmp_path / "root")
    found = {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in E.payload_errors(spark, folder).collect()}
    assert found == {("b.json", "malformed"), ("c.json", "no object"), ("d.json", "empty"), ("batch_003", "no files")}
    assert E.read_envelopes(spark, folder, "r").count() == 1
    with pytest.raises(E.BrokenPayloads):
        loading.stage_folder(spark, folder, str(tmp_path / "raw"), root, "dag", "r")
    assert not (tmp_path / "raw").exists()
    (state,) = ledger.batch_state(spark.read.parquet(loading.events_path(root))).collect()
    assert state["status"] == "FAILED" and "4 broken payloads" in state["error_message"]
    for name in list(files)[1:]:
        (tmp_path / "in" / name).write_text(sound)
    (tmp_path / "in" / "batch_003").rmdir()
    loading.stage_folder(spark, folder, str(tmp_path / "raw"), root, "dag", "r")
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 4


def test_payload_experiment(spark, generated):
    from dqloom.operators import marts
    from dqloom.plans import experiment

    base = marts.add_marts(flatten.load_star(generated, "base"))

    def run(*staging, loading=()):
        it = experiment.Iteration("it", staging, loading, 3, "seed")
        return experiment.run_payload_iteration(generated, "gen", it, base, skip_gates=skip)

    skip = ()
    spark.sparkContext.setJobGroup("iteration", "jobs of one iteration")
    swapped = run(("matches", "swap_teams"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("iteration"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # storing the copy and seven tables, and one evaluation before and after the load, however many gates there are
    assert jobs <= 80
    assert swapped.stopped_at is None and len(swapped.results) == 2 + 23 + 15
    skip = ("schema",)
    assert swapped.changes["mart_team"].filter("change = 'changed'").count() > 0
    assert swapped.changes["mart_kpi"].filter("change <> 'changed'").count() == 0
    assert run(("matches", "duplicate_first")).stopped_at == "uniqueness"
    assert run(("matches", "drop_matches_key")).stopped_at == "ingestion"
    bad = run(loading=("fact_match",))
    # The planted match has no teams; it is unknown to the source.
    assert bad.stopped_at == "source_exclusivity"
    assert experiment.run_payload_iteration(generated, "gen", experiment.Iteration("it")).stopped_at is None
    forgiven = experiment.Iteration("off", (), ("fact_match",), kind="dds_mutation", from_run="gen", validations={"matches_source_exclusivity": False})
    outcome = experiment.run_payload_iteration(generated, "other", forgiven, base)
    assert outcome.stopped_at != "source_exclusivity" and "matches_source_exclusivity" not in {r["check_name"] for r in outcome.results}
    still = experiment.run_payload_iteration(generated, "gen", experiment.Iteration("still", kind="snapshot"), base)
    assert still.results == [] and still.changes["mart_team"].count() == 0
    with pytest.raises(ValueError):
        experiment.Iteration("x", kind="y")
    compared = experiment.compare_iterations([swapped, bad]).collect()
    assert ("it", "source_exclusivity", None, None, None) in {tuple(r) for r in compared}
    assert any(r["mart"] == "mart_team" and r["change"] == "changed" and r["rows"] > 0 for r in compared)


def test_targets_of_a_stage_are_validated_once(spark, small, tmp_path):
    from dqloom.plans import dispatch, loading, strategies

    root = str(tmp_path)
    for layer, parent, run, status in (
        ("STG", "s1", "s1", "SUCCESS"), ("DDS", "s1", "d1", "SUCCESS"), ("STG", "s1", "exp_a", "SUCCESS"), ("DDS", "exp_a", "exp_da", "SUCCESS"),
    ):
        tables.append_ledger(ledger.batch_event(spark, "dag", run, parent, layer, status), loading.events_path(root))
    bad, given = testbed.entity_tables(small, True), testbed.entity_tables(small)
    clean = {n: given[n] for n in given}
    clean["matches"] = given["matches"].filter("home_team_id <> away_team_id").dropDuplicates(["id"])
    both = testbed.Lazy(
        {n: lambda n=n: clean[n].withColumn("run_id", F.lit("d1")).unionByName(bad[n].withColumn("run_id", F.lit("exp_da"))) for n in clean}
    )
    strategy = strategies.universal("soda", ("T",), only_unprocessed=True)

    def run():
        return dispatch.run_stage_targets(spark, root, "T", strategy, "s1", lambda targets: both, "dag").collect()

    ((stage, suite, runs, passed, failed, checks_failed),) = run()
    assert (stage, suite, runs, passed, failed) == ("T", "soda", 2, 1, 1) and checks_failed > 0
    # what has finished is not looked at again, a failed run is
    assert [(r["runs"], r["failed"]) for r in run()] == [(1, 1)]
    assert spark.read.parquet(dispatch.runs_path(root)).count() == 3
    assert spark.read.parquet(dispatch.results_path(root)).filter("status = 'FAIL'").count() == 2 * checks_failed
    stars = [testbed.star_tables(small, run_id=run) for run in ("d1", "exp_da")]
    star = testbed.Lazy({n: lambda n=n: stars[0][n].unionByName(stars[1][n]) for n in stars[0]})
    tally, sizes = dispatch.run_post_targets(spark, root, lambda targets: star, "dag")
    assert [r["runs"] for r in tally.collect()] == [2]
    assert {(r["run_id"], r["table"]) for r in sizes.collect()} == {(d, m) for d in ("d1", "exp_da") for m in ("mart_kpi", "mart_team")}
    assert dispatch.run_post_targets(spark, root, lambda targets: star, "dag")[0].count() <= 1


def _entities_of_runs(spark, runs):
    """Small tables of several runs; run number ``i`` has ``i`` matches that break each rule."""
    rows = {"areas": [], "competitions": [], "teams": [], "matches": [], "standings": []}
    for i, run in enumerate(runs):
        rows["areas"].append((run, 1, "a"))
        rows["competitions"].append((run, 1, "c"))
        rows["teams"] += [(run, 10 + i, "t"), (run, 20, "u")]
        rows["matches"].append((run, 1, 1, 1, "FINISHED", 1, 10 + i, 20))
        for k in range(i):
            # unknown to this run, known to another; the same id twice
            rows["matches"] += [(run, 100 + k, 1, 1, "FINISHED", 1, 11 + i, 20)] * 2
        rows["standings"].append((run, 1, 1, 20, 3, 1, 0, 1))
    layout = {
        "areas": "id BIGINT, name STRING", "competitions": "id BIGINT, name STRING", "teams": "id BIGINT, name STRING",
        "matches": "id BIGINT, competition_id BIGINT, season_id BIGINT, status STRING, matchday INT, home_team_id BIGINT, away_team_id BIGINT",
        "standings": "season_id BIGINT, competition_id BIGINT, team_id BIGINT, points INT, won INT, draw INT, playedGames INT",
    }
    return {n: spark.createDataFrame(rows[n], f"run_id STRING, {layout[n]}") for n in rows}


def test_runs_together_are_judged_like_each_alone(spark, small):
    from dqloom.operators import runs as R

    names = ["r0", "r1", "r2", "r3"]
    given = _entities_of_runs(spark, names)
    given["matches"] = given["matches"].withColumn("utcDate", F.lit(None).cast("timestamp_ntz"))
    targets = spark.createDataFrame([(n,) for n in [*names, "nothing"]], "run_id STRING")
    placed = [fusion.Placed(s.name, stage, c) for s in suites.ENTITY_SUITES.values() for stage in ("E", "T", "L") for c in s.checks(stage)]
    placed.append(fusion.Placed("own", "E", C.all_loaded("loaded", "matches", ("home_team_id",), "teams", ("id",))))
    placed.append(fusion.Placed("own", "E", C.none_invented("invented", "matches", ("home_team_id",), "teams", ("id",))))
    found = {tuple(r) for r in R.evaluate(placed, given, targets).collect()}
    assert len(found) == len(placed) * 5
    for run in [*names, "nothing"]:
        alone = {n: rows.filter(F.col("run_id") == run).drop("run_id") for n, rows in given.items()}
        assert {r[1:] for r in found if r[0] == run} == {tuple(r) for r in fusion.evaluate_placed(placed, alone).collect()}
    # tables of other runs do not matter
    some = targets.filter("run_id = 'r2'")
    assert {tuple(r) for r in R.evaluate(placed, given, some).collect()} == {r for r in found if r[0] == "r2"}


def test_a_run_whose_values_a_check_cannot_bear(spark):
    from dqloom.operators import runs as R

    rows = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "-1")], "run_id STRING, v STRING")
    placed = [fusion.Placed("own", "E", c) for c in (
        C.rows_where("strict", "t", "cast(v AS INT) < 0"), C.not_empty("there", "t"), C.rows_where("unknown", "t", "w < 0"), C.not_empty("lost", "u"),
    )]
    targets = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run_id STRING")
    found = {(r["run_id"], r["check_name"]): (r["status"], r["rows_failed"]) for r in R.evaluated(placed, {"t": rows}, targets).collect()}
    assert [found[r, "strict"] for r in "abcd"] == [("PASS", 0), ("ERROR", -1), ("FAIL", 1), ("PASS", 0)]
    assert [found[r, "there"] for r in "abcd"] == [("PASS", 0)] * 3 + [("FAIL", 1)]
    assert {found[r, c] for r in "abcd" for c in ("unknown", "lost")} == {("ERROR", -1)}


def test_jobs_do_not_grow_with_the_runs(spark, tmp_path):
    from dqloom.plans import dispatch, loading, strategies

    def jobs(n):
        root, names = str(tmp_path / str(n)), [f"exp_{i}" for i in range(n)]
        given = _entities_of_runs(spark, names)
        events = [ledger.batch_event(spark, "dag", run, "s1", "DDS", "SUCCESS") for run in names]
        tables.append_ledger(reduce(DataFrame.unionByName, events).coalesce(1), loading.events_path(root))
        group = f"dispatch {n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            found = dispatch.run_stage_targets(spark, root, "T", strategies.universal("soda", ("T",)), "s1", lambda targets: given, "dag").collect()
            issued = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [(r["runs"], r["failed"]) for r in found] == [(n, n - 1)]
        assert spark.read.parquet(dispatch.runs_path(root)).count() == n
        state = {r["run_id"]: r["status"] for r in ledger.batch_state(spark.read.parquet(loading.events_path(root))).filter("layer = 'T_SODA'").collect()}
        assert state == {run: "FAILED" if i else "SUCCESS" for i, run in enumerate(names)}
        return issued

    few, many = jobs(3), jobs(12)
    assert many <= few + 2


def test_settings_of_checks():
    from dqloom.operators import checks as C

    config = {"match_home_away_diff": {"severity": "WARNING"}, "match_status_invalid": {"enabled": False}}
    found = {c.name: c.severity for c in C.configured(suites.SQL.checks("T"), config)}
    assert len(found) == 6 and found["match_home_away_diff"] == "warning" and found["dds_matchday_out_of_range"] == "error"
