"""Tables by parts: replay, crash, merge, expiry; late rows and statistics that follow the stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from liftwise.operators.attribution import load_design, variant_stats
from liftwise.operators.normalize import metric_specs
from liftwise.schemas import METRIC_EVENTS
from liftwise.sources.generations import Generations
from liftwise.streaming import incremental, ingest, state
from tests.helpers import UTC, at, runs

EVALS = "env_id string, flag_key string, user_key string, variant string, experiment_id string, layer_id string, hash_bucket short, timestamp timestamp, user_properties string"


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def values(df):
    return sorted(r.v for r in df.collect())


def test_parts_land_once_and_merge(spark, tmp_path):
    table = Generations(spark, str(tmp_path), "v long")
    assert values(table.read()) == [] and table.landed() is None
    for batch in range(20):
        assert table.append(numbers(spark, batch), batch)
        assert not table.append(numbers(spark, -1), batch)  # a replay adds nothing
        table.compact(fan_in=3)
    with pytest.raises(ValueError):
        table.append(numbers(spark, 1), 3)
    parts = table.manifest()[1]
    assert values(table.read()) == list(range(20)) and len(parts) <= 6 and parts[-1].last == 19
    assert values(table.read(before=19)) == list(range(19)) and 19 in values(table.read(after=18))
    assert table.vacuum(keep_versions=1) and values(table.read()) == list(range(20))


def test_a_crash_before_the_switch_loses_nothing(spark, tmp_path, monkeypatch):
    table = Generations(spark, str(tmp_path), "v long")
    for batch in range(3):
        table.append(numbers(spark, batch), batch)
    reader = table.read()

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Generations, "_commit", crash)
        for step in (lambda: table.append(numbers(spark, 3), 3), lambda: table.compact(fan_in=3)):
            with pytest.raises(OSError):
                step()
    assert values(table.read()) == [0, 1, 2]
    assert table.append(numbers(spark, 3), 3) and table.compact(fan_in=4) == 1
    assert values(table.read()) == [0, 1, 2, 3] and len(table.manifest()[1]) == 1
    assert values(reader) == [0, 1, 2]  # it goes on with the parts of its version
    table.vacuum(keep_versions=1)
    assert values(table.read()) == [0, 1, 2, 3]


def test_every_row_is_kept_a_repeat_or_late(spark, tmp_path):
    table = ingest.landing(spark, str(tmp_path / "e"), METRIC_EVENTS, "event_name", ingest.EVENT_ID)
    rng, seen, latest = random.Random(3), set(), None
    for batch in range(4):
        rows = [("e", "n", f"u{rng.randrange(4)}", rng.choice((None, 1.0)), at("2024-01-01") + dt.timedelta(days=3 * batch - rng.choice((0, 1, 2, 8)), hours=rng.randrange(3)), "{}") for _ in range(60)]
        rows += [("e", "n", "u", 1.0, None, "{}")]
        bound = None if latest is None else latest - dt.timedelta(days=2)
        late = [r for r in rows if r[4] is None or bound is not None and r[4] < bound]
        ours = {r[:5] for r in rows if r not in late}
        want = {"rows": 61, "kept": len(ours - seen), "late": len(late), "repeated": 61 - len(late) - len(ours - seen)}
        got = ingest.land(spark.createDataFrame(rows, METRIC_EVENTS), batch, table, "2 days", fan_in=2)
        assert got == want == ingest.land(spark.createDataFrame(rows, METRIC_EVENTS), batch, table, "2 days", fan_in=2)
        seen |= ours
        latest = max(r[4] for r in rows if r[4] is not None and r not in late)
    assert table.rows.read().count() == len(seen) and table.late.read().where("timestamp is null").count() == 4


def test_short_lateness_is_refused(spark):
    with pytest.raises(ValueError):
        state.daily_exposed_users(spark.createDataFrame([], EVALS), "23 hours")


def test_statistics_follow_changed_exposures(spark, tmp_path):
    """Late evaluations move users to other variants and bring earlier events in."""
    run = {"run_id": "r", "env_id": "e", "flag_key": "f", "control_variant": "a", "treatment_variant": "b", "observation_start": at("2024-01-01"), "observation_end": at("2024-01-30"),
           "primary_metric_event": "buy", "primary_metric_type": "continuous", "primary_metric_agg": "sum", "guardrail_events": '["click"]'}
    both = runs(spark, [run, {**run, "run_id": "s", "primary_metric_agg": "average", "observation_start": at("2024-01-04")}])
    design = load_design(both, metric_specs(both))
    rng = random.Random(8)

    def instant(day):
        return dt.datetime(2024, 1, day, rng.randrange(24), tzinfo=UTC)

    evals = [[("e", "f", f"u{rng.randrange(25)}", rng.choice("ab"), None, None, 0, instant(max(2 * b + rng.choice((1, 1, -1)), 1)), "{}") for _ in range(20)] for b in range(1, 5)]
    events = [[("e", rng.choice(("buy", "click", "other")), f"u{rng.randrange(25)}", rng.choice((None, 1.5, 2.0)), instant(2 * b + 1), "{}") for _ in range(40)] for b in range(1, 5)]
    running = incremental.RunningStatistics(spark, str(tmp_path / "s"), "10 days", fan_in=2)
    for b in range(4):
        new = spark.createDataFrame(evals[b], EVALS), spark.createDataFrame(events[b], METRIC_EVENTS)
        running.advance(*new, design, b)
        running.advance(*new, design, b)  # a repeated step adds nothing
    columns = ["run_id", "metric_ord", "variant", "users", "conversions", F.round("sum_val", 6), F.round("sum_sq", 6)]
    whole = variant_stats(spark.createDataFrame(sum(evals, []), EVALS), spark.createDataFrame(sum(events, []), METRIC_EVENTS), design)
    got, want = (sorted(tuple(r) for r in df.select(*columns).collect()) for df in (running.statistics(design), whole))
    assert got == want and len(want) == 8
