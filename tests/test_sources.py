import json

import pytest
from pyspark.sql import functions as F

from liftwise.plans.analyze import analyze, analyze_statistics
from liftwise.session import materialize, scratch_dir
from liftwise.sources import payloads as pl
from liftwise.sources import sinks, statistics, tables
from liftwise.streaming import state
from tests.helpers import at, runs, stats
from workload import fixtures as fx

HEAD = {"schemaVersion": 1, "experimentId": "x", "computedAt": "t"}


def document(kind, agg, data, **head):
    return json.dumps({**HEAD, **head, "metrics": {"m": {"type": kind, "agg": agg, "data": data}}})


GOOD = {
    "rate": (document("binary", "once", {"c": {"n": 100, "k": 12}}), {"n": 100, "k": 12}),
    "mean": (document("continuous", "sum", {"c": {"n": 100, "mean": 5.0, "stddev": 2.0}}), {"n": 100, "mean": 5, "variance": 4}),
    "sums": (document("continuous", "sum", {"c": {"n": 4, "sum": 20, "sum_squares": 120}}), {"n": 4, "mean": 5, "variance": 20 / 3}),
    "one": (document("continuous", "sum", {"c": {"n": 1, "sum": 20, "sum_squares": 400}}), {"n": 1, "mean": 20, "variance": 0}),
    "none": (document("continuous", "sum", {"c": {"n": 0, "sum": 0, "sum_squares": 0}}), {"n": 0, "mean": 0, "variance": 0}),
}
BAD = {
    "null": ("null", "not a JSON object"), "version": (document("binary", "once", {}, schemaVersion=2), "unsupported schemaVersion: 2"),
    "computed": (json.dumps({"schemaVersion": 1, "experimentId": "x", "metrics": {}}), "computedAt missing"),
    "type": (document("ratio", "once", {}), "type must be"), "agg": (document("binary", "last", {}), "agg must be"),
    "keys": (document("continuous", "sum", {"c": {"n": 10}}), "missing required keys"),
    "n": (document("binary", "once", {"c": {"n": "ten", "k": 1}}), ".n must be a finite number"),
    "quoted": (document("binary", "once", {"c": {"n": "10", "k": 1}}), ".n must be a finite number"),
    "negative": (document("binary", "once", {"c": {"n": -1, "k": 1}}), "at least 0"),
    "k": (document("binary", "once", {"c": {"n": 1}}), ".k must be a finite number"),
}


def test_documents(spark):
    rows = [(k, v[0]) for k, v in {**GOOD, **BAD}.items()]
    normal = statistics.normalise_documents(spark.createDataFrame(rows, "run_id string, body string"))
    good, bad = statistics.split_documents(normal)
    got = {r.run_id: r.asDict() for r in good.collect()}
    assert set(got) == set(GOOD)
    for name, (_, want) in GOOD.items():
        assert {c: got[name][c] for c in want} == {c: pytest.approx(v) for c, v in want.items()}
    errors = {r.run_id: r.error for r in bad.collect()}
    assert set(errors) == set(BAD)
    for name, (_, text) in BAD.items():
        assert text in errors[name], name


def test_documents_of_one_file_are_parsed_by_many_tasks(spark):
    rows = [(str(i), document("binary", "once", {"c": {"n": i, "k": 1}})) for i in range(400)]
    docs = spark.createDataFrame(rows, "run_id string, body string").coalesce(1)
    normal = statistics.normalise_documents(docs)
    parts = {(r[0], r[1]) for r in normal.select("run_id", F.col("_metadata.file_path")).collect()}
    assert len(parts) == 400 and len({p for _, p in parts}) > 1
    good, bad = statistics.split_documents(normal)
    plan = good._jdf.queryExecution().optimizedPlan().toString() + bad._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan and good.count() == 400 and bad.count() == 0  # no filter parses anew


def test_documents_from_files(spark, tmp_path):
    for name, (body, _) in GOOD.items():
        (tmp_path / f"{name}.json").write_text(body)
    docs = statistics.read_documents(spark, str(tmp_path)).withColumn("run_id", F.regexp_extract("source", r"(\w+)\.json$", 1))
    good, bad = statistics.split_documents(statistics.normalise_documents(docs))
    assert good.count() == len(GOOD) and bad.count() == 0


def test_payload_errors_and_defaults(spark):
    ok = '[{"user":{"keyId":"u","properties":{}},"variations":[{"flagKey":"f","timestamp":1704067200123}],"unknown":1},' \
         '{"metrics":[{"eventName":"e","timestamp":0,"numericValue":2}]}]'
    bodies = [(1, "env", ok), (2, "env", "{"), (3, "env", "[]"), (4, "env", '[{"variations":[{"timestamp":"soon"}]}]'), (5, "env", '{"user":1}')]
    decoded = pl.decode_payloads(spark.createDataFrame(bodies, "batch_id int, env_id string, body string"))
    assert {r.batch_id: r.error for r in pl.rejected(decoded).collect()} == {
        2: "Invalid JSON body", 3: "Empty payload", 4: "Invalid JSON body", 5: "Invalid JSON body"}
    e = pl.flag_evaluations(decoded).first()
    assert (e.user_key, e.flag_key, e.variant, e.layer_id, e.user_properties) == ("u", "f", "", None, "{}")
    assert pl.flag_evaluations(decoded).select(F.unix_millis("timestamp").alias("t")).first().t == 1704067200123
    m = pl.metric_events(decoded).first()
    assert (m.user_key, m.event_name, m.numeric_value) == ("", "e", 2.0)


def test_scans_prune_months_and_push_filters(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    tables.write_tables(fx.evaluations(spark, d), fx.metric_events(spark, d), str(tmp_path))
    df = tables.read_events(spark, str(tmp_path), "env-1", "1-URGENT", "1996-02-10", "1996-03-05").select("user_key")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(event_month" in plan and "EqualTo(event_name,1-URGENT)" in plan
    assert "GreaterThanOrEqual(timestamp" in plan and "user_properties" not in plan.split("ReadSchema")[1]
    read = df.select(F.regexp_extract(F.input_file_name(), r"event_month=(\d+)", 1).cast("int").alias("m")).distinct()
    months = {r.m for r in read.collect()}
    assert months <= {199602, 199603} and months


def test_manual_rows(spark):
    rows = [("r", 0, "m", "binary", " a ", "10", "3", None, True), ("r", 0, "m", "binary", "b", "0", "3", None, None),
            ("r", 0, "m", "binary", " ", "5", "3", None, None), ("r", 1, "w", "continuous", "a", "4", "", None, None)]
    df = spark.createDataFrame(rows, "run_id string, metric_ord int, metric string, metric_type string, variant string, n string, s string, ss string, inverse boolean")
    got = [(r.metric, r.variant, r.n, r.k, r["sum"], r.sum_squares, r.inverse) for r in statistics.manual_statistics(df).orderBy("metric").collect()]
    assert got == [("m", "a", 10.0, 3.0, None, None, True), ("w", "a", 4.0, None, 0.0, 0.0, None)]


def test_input_data_round_trip(spark):
    s = stats(spark, [("r", 0, 'buy "now"', "primary", True, "a", {"n": 10, "k": 3}), ("r", 0, 'buy "now"', "primary", True, "b", {"n": 11, "k": 4}),
                      ("r", 1, "wait", "guardrail", False, "a", {"n": 10, "sum": 3.5, "sum_squares": 9})])
    doc = sinks.input_data_json(s).first().input_data
    assert json.loads(doc)["metrics"] == {'buy "now"': {"a": {"n": 10.0, "k": 3.0}, "b": {"n": 11.0, "k": 4.0}, "inverse": True},
                                          "wait": {"a": {"n": 10.0, "sum": 3.5, "sum_squares": 9.0}}}
    back = statistics.stored_statistics(sinks.input_data_json(s)).orderBy("metric_ord", "variant").collect()
    assert [(r.metric, r.variant, r.inverse, r.n, r.k, r["sum"]) for r in back] == [
        ('buy "now"', "a", True, 10, 3, None), ('buy "now"', "b", True, 11, 4, None), ("wait", "a", None, 10, None, 3.5)]


def test_results_replace_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([("a", "1"), ("b", "1")], "run_id string, analysis_result string")
    two = spark.createDataFrame([("b", "2"), ("c", "2")], "run_id string, analysis_result string")
    sinks.write_results(one, path)
    sinks.write_results(two, path)
    assert {(r.run_id, r.analysis_result) for r in spark.read.parquet(path).collect()} == {("a", "1"), ("b", "2"), ("c", "2")}


def test_analyze_stored_runs_with_renamed_variants(spark):
    data = json.dumps({"metrics": {"buy": {"Blue": {"n": 1000, "k": 100}, "Red": {"n": 1010, "k": 150}}}})
    designs = runs(spark, [
        {"run_id": "renamed", "control_variant": "variation-a", "treatment_variant": "variation-b", "primary_metric_event": "buy",
         "input_data": data, "data_source_mode": "manual", "slug": "s", "method": "frequentist"},
        {"run_id": "partly", "control_variant": "Grey", "treatment_variant": "Red", "primary_metric_event": "buy", "input_data": data, "slug": "s"},
        {"run_id": "empty", "control_variant": "Blue", "treatment_variant": "Red", "primary_metric_event": "sell", "input_data": data, "slug": "s"},
    ])
    evals = spark.createDataFrame([], "env_id string, flag_key string, user_key string, variant string, timestamp timestamp, user_properties string")
    events = spark.createDataFrame([], "env_id string, event_name string, user_key string, numeric_value double, timestamp timestamp")
    s, results = analyze(evals, events, designs, "2024-02-01 00:00:00")
    assert {r.data_source for r in s.select("data_source").distinct().collect()} == {"stored"}
    got = {r.run_id: r for r in results.collect()}
    assert got["renamed"].variants_corrected and got["empty"].status == "no_primary_metric_rows" and got["empty"].analysis_result is None
    doc = json.loads(got["renamed"].analysis_result)
    assert doc["control"] == "Blue" and doc["treatments"] == ["Red"] and doc["primary_metric"]["rows"][1]["p_win"] > 0.99
    assert doc["warnings"] == ["frequentist runs are analysed as bayesian_ab"]
    doc = json.loads(got["partly"].analysis_result)
    assert "primary_metric" not in doc and doc["warnings"][0].startswith("The run is set up for [Grey, Red], its data holds [Blue, Red].")


def test_late_exposure_corrects_the_first(spark, tmp_path):
    schema = "env_id string, flag_key string, user_key string, variant string, timestamp timestamp"
    spark.createDataFrame([("e", "f", "u", "b", at("2024-01-02"))], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run():
        table = state.first_exposure_table(spark, str(tmp_path / "out"))
        q = state.run_versions(state.running_first_exposures(stream), table, state.merge_first_exposures, str(tmp_path / "check"))
        assert q.awaitTermination(120)
        return state.read_first_exposures(table).first()

    assert run().variant == "b"
    spark.createDataFrame([("e", "f", "u", "a", at("2024-01-01"))], schema).write.mode("append").parquet(str(tmp_path / "in"))
    late = run()
    assert late.variant == "a"


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert path.startswith(base) if base else path
    df = spark.range(5).withColumn("v", F.rand(1))
    kept = materialize(df)
    assert kept.count() == 5 and kept.columns == ["id", "v"]


def test_bodies_of_wrong_types_and_times_are_quarantined(spark):
    good = '[{"user": {"keyId": "u"}, "variations": [{"flagKey": "f", "variant": "a", "timestamp": 1704067200000}], "metrics": []}]'
    bad = {
        '[{"variations": "oops"}]': "Invalid JSON body", '[{"metrics": {"eventName": "e"}}]': "Invalid JSON body",
        '[{"user": [1]}]': "Invalid JSON body", '[{"variations": [1]}]': "Invalid JSON body",
        '[{"metrics": [{"eventName": "e", "timestamp": 9000000000000000000}]}]': "Timestamp out of range",
        '[{"variations": [{"flagKey": "f", "timestamp": -90000000000000000}]}]': "Timestamp out of range",
    }
    decoded = pl.decode_payloads(spark.createDataFrame([("e", b) for b in [good, *bad]], "env_id string, body string"))
    assert {r.body: r.error for r in decoded.collect()} == {good: None, **bad}
    assert [r.user_key for r in pl.flag_evaluations(decoded).collect()] == ["u"] and not pl.metric_events(decoded).collect()
    plan = pl.flag_evaluations(decoded)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(env") == 0 and plan.count("from_json") <= 4


def test_sources_of_runs_stay_apart(spark):
    body = '{"schemaVersion": 1, "experimentId": "x", "metrics": {}}'
    routed = spark.createDataFrame([("a", 0, "m", "b|c", "p", None), ("a|b", 0, "m", "c", "p", None)], "run_id string, metric_ord int, event_name string, provider string, path string, error string")
    documents = spark.createDataFrame([("b|c", "p", "a", body)], "provider string, path string, run_id string, body string")
    _, failures = statistics.read_routed(routed, documents)
    assert "a|b" in {r.run_id for r in failures.collect()}


def test_explicit_inverse_wins(spark):
    from liftwise.operators.normalize import metric_specs
    docs = [("r", '{"metrics": {"m": {"inverse": false, "a": {"n": 1, "k": 1}}, "g": {"a": {"n": 1, "k": 1}}}}')]
    stored = statistics.stored_statistics(spark.createDataFrame(docs, "run_id string, input_data string"))
    specs = metric_specs(runs(spark, [{"run_id": "r", "primary_metric_event": "p", "guardrail_events": '[{"event": "m", "inverse": true}, {"event": "g", "inverse": true}]'}]))
    assert {r.metric: r.inverse for r in statistics.with_specs(stored, specs).collect()} == {"m": False, "g": True}


def test_primary_that_is_also_guardrail(spark):
    from liftwise.operators.normalize import metric_specs
    row = {"run_id": "r", "primary_metric_event": "m", "guardrail_events": '["g", {"event": "m", "metricType": "continuous", "metricAgg": "sum", "inverse": true}]'}
    got = [(r.role, r.event_name, r.metric_type, r.inverse) for r in metric_specs(runs(spark, [row])).orderBy("metric_ord").collect()]
    assert got == [("primary", "m", "continuous", True), ("guardrail", "g", "binary", False)]


def test_repeated_arms_are_one(spark):
    from liftwise.operators.normalize import run_violations
    row = runs(spark, [{"run_id": "r", "control_variant": "c", "treatment_variant": "t, t,c , u"}])
    assert row.first().treatments == ["t", "u"] and run_violations(row).first().violations
