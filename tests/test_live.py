"""Live streams against their batch twins, and the models they use."""

import datetime as dt
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netlat.operators import align as al
from netlat.operators import model as md
from netlat.operators import series as sr
from netlat.operators.rates import snapshot_rates
from netlat.plans import jobs
from netlat.schemas import COUNTERS, FEATURES, GAUGES, LEVELS, SNAPSHOT_SCHEMA
from netlat.sources.tables import read_dataset, write_augmented, write_dataset, write_report
from netlat.streaming import live

START = dt.datetime(2025, 11, 22, 12, 0, 0)


def snapshots(hosts=("h1", "h2"), n=20, seed=0, reset=True):
    rng = np.random.default_rng(seed)
    rows = []
    for h in hosts:
        totals = dict.fromkeys(COUNTERS, 1000)
        for i in range(n):
            if reset and i == 7:
                totals = dict.fromkeys(COUNTERS, 0)
            totals = {c: v + int(rng.integers(0, 50)) for c, v in totals.items()}
            row = {"host": h, "timestamp": (START + dt.timedelta(seconds=i * 1.5)).isoformat()}
            row |= {c: float(rng.uniform(1, 100)) for c in GAUGES} | {c: int(rng.integers(0, 5)) for c in LEVELS} | totals
            rows.append(row)
    return rows


def put(folder, name, rows):
    """Write a file of rows; files are read in the order of their times."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    at = 1_700_000_000 + 10 * int(name.split(".")[0])
    os.utime(folder / name, (at, at))


def run(stream, path, checkpoint):
    live.start_predictions(stream, str(path), str(checkpoint), available_now=True).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(path))


def by_time(df):
    return df.toPandas().sort_values(["host", "time"]).reset_index(drop=True)


@pytest.mark.parametrize("clip", [True, False])
def test_stream_equals_batch_over_several_batches(spark, tmp_path, clip):
    rows = snapshots()
    for i in range(4):
        part = [r for r in rows if i * 7.5 <= (dt.datetime.fromisoformat(r["timestamp"]) - START).total_seconds() < (i + 1) * 7.5]
        put(tmp_path / "in", f"{i}.json", part[::-1])
    source = live.snapshot_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = by_time(run(live.stream_features(source, steps=6, clip=clip), tmp_path / "out", tmp_path / "state"))
    batch = snapshot_rates(spark.read.schema(SNAPSHOT_SCHEMA).json(str(tmp_path / "in")), clip=clip)
    want = by_time(batch)
    assert len(got) == 40
    pd.testing.assert_frame_equal(got[["host", "time", *FEATURES]], want[["host", "time", *FEATURES]])
    padded = by_time(sr.sequences(batch, FEATURES, "host", "time", 6, pad=True, rows=100))
    np.testing.assert_allclose(np.stack(got.features), np.stack(padded.features))


def test_equal_times_stay_and_older_rows_are_dropped_and_counted(spark, tmp_path):
    rows = snapshots(hosts=("h",), n=6)
    put(tmp_path / "in", "0.json", [*rows[:3], rows[1]])
    source = lambda: live.snapshot_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    stream = live.stream_features(source(), steps=3)
    assert run(stream, tmp_path / "out", tmp_path / "state").count() == 4
    put(tmp_path / "in", "1.json", [rows[0], rows[4]])
    out = by_time(run(live.stream_features(source(), steps=3), tmp_path / "out", tmp_path / "state"))
    assert len(out) == 5 and out.dropped.tolist()[-1] == 1


def test_stream_has_the_batch_s_rows_at_equal_times(spark, tmp_path):
    rows = snapshots(hosts=("h",), n=6, reset=False)
    rows[2]["timestamp"] = rows[1]["timestamp"]
    put(tmp_path / "in", "0.json", rows[:2])
    put(tmp_path / "in", "1.json", rows[2:])
    stream = live.stream_features(live.snapshot_stream(spark, str(tmp_path / "in"), files_per_trigger=1), steps=3)
    got = run(stream, tmp_path / "out", tmp_path / "state").toPandas()
    want = snapshot_rates(spark.createDataFrame(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))).toPandas()
    show = lambda df: sorted(map(tuple, df[["total_packets_per_sec", "used_MB", "nic_usage_pct"]].round(6).to_numpy().tolist()))
    assert len(got) == 6 and show(got) == show(want)


def test_many_rows_of_one_host_come_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SLICE", 4)
    rows = snapshots(hosts=("h",), n=11)
    put(tmp_path / "in", "0.json", rows)
    stream = live.stream_features(live.snapshot_stream(spark, str(tmp_path / "in")), steps=3)
    out = by_time(run(stream, tmp_path / "out", tmp_path / "state"))
    flat = np.stack(out.features).reshape(11, 3, -1)
    assert len(out) == 11 and (flat[1:, 1] == flat[:-1, 2]).all()

def test_first_rates_and_equal_times(spark):
    rows = snapshots(hosts=("h",), n=3, reset=False)
    rows[2]["timestamp"] = rows[1]["timestamp"]
    df = spark.createDataFrame(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    got = by_time(snapshot_rates(df))
    assert got.total_packets_per_sec[0] == 0 and got.used_MB[0] == rows[0]["mem_total_mb"] - rows[0]["mem_avail_mb"]
    assert np.isfinite(got[FEATURES].to_numpy()).all()


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    """A series whose next rows follow from its last, so that a model can learn it."""
    rng = np.random.default_rng(5)
    rows = []
    for r in range(3):
        level = 0.0
        for i in range(120):
            level = 0.5 * level + rng.normal(0, 1)
            spike = 40.0 if i % 12 > 8 else 0.0
            rows.append((f"run{r}", START + dt.timedelta(seconds=i), 50 + level + spike, float(i % 12), 7.0))
    df = spark.createDataFrame(rows, "run_id string, time timestamp, RTT_ms_mean double, phase double, flat double")
    data, mm = jobs.training_set(df, cols=["RTT_ms_mean", "phase", "flat"], steps=4, horizon=3)
    path = str(tmp_path_factory.mktemp("set"))
    write_dataset(data, mm, path)
    return read_dataset(spark, path)


def test_trees_beat_persistence(spark, trained):
    data, mm = trained
    out = jobs.evaluate(data, {"gbt": md.gbt(maxIter=10, maxDepth=3), "linear": md.baselines()["linear"]}, mm)
    m = {r.model: r for r in out["metrics"].collect()}
    assert m["gbt"].rmse < m["persistence"].rmse / 2 and m["gbt"].r2 > 0.8
    assert out["best"].first().model in ("gbt", "linear")
    assert out["gap"].first().better in ("gbt", "linear")
    samples = out["samples"].collect()
    assert samples and all(r["pos"] % 50 == 0 and 0 < r["y_target"] < 200 and 0 < r["gbt"] < 200 for r in samples)


def test_a_stored_model_predicts_the_same(spark, trained, tmp_path):
    data, mm = trained
    model = md.fit_gbt(data.where("split = 'train'"), maxIter=3, maxDepth=2)
    md.save_model(model, str(tmp_path / "m"))
    again = md.load_model(spark, str(tmp_path / "m"))
    show = lambda m: sorted(md.score(data, m, mm).select("pos", "prediction").collect())
    assert show(model) == show(again)


def test_grid_search_uses_the_given_folds(spark, trained, tmp_path):
    data, _ = trained
    tuned = jobs.train(data, {"maxIter": [1, 5], "maxDepth": [2]}, store=str(tmp_path / "winner"))
    table = md.grid_table(spark, tuned).toPandas()
    kept, own = (jobs.evaluate(data, {"gbt": m}, trained[1])["metrics"].collect() for m in (str(tmp_path / "winner"), tuned.bestModel))
    assert sorted(kept) == sorted(own)
    assert len(table) == 2 and tuned.bestModel.getNumTrees == 5
    assert table.mse[1] < table.mse[0]
    folded = jobs.importance(spark, tuned.bestModel, ["RTT_ms_mean", "phase", "flat"])
    assert {r.feature for r in folded.collect()} == {"RTT_ms_mean", "phase", "flat"}
    assert folded.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert jobs.importance(spark, tuned.bestModel, ["RTT_ms_mean", "phase", "flat"], top=1).count() == 1


def test_live_job_writes_predictions_and_alerts(spark, tmp_path):
    put(tmp_path / "in", "0.json", snapshots(n=30))
    batch = snapshot_rates(spark.read.schema(SNAPSHOT_SCHEMA).json(str(tmp_path / "in")))
    data, mm = jobs.training_set(batch, run="host", steps=3, horizon=2)
    model = md.fit_gbt(data.where("split = 'train'"), maxIter=3, maxDepth=2)
    queries = live.live_job(
        spark, str(tmp_path / "in"), model, mm, str(tmp_path / "out"), str(tmp_path / "state"), threshold=20.0, steps=3, available_now=True
    )
    for q in queries:
        q.awaitTermination()
    made = spark.read.parquet(str(tmp_path / "out" / "predictions"))
    assert made.count() == 60 and made.where("prediction IS NULL").count() == 0
    # The stream scores what the batch job scores.
    windows = sr.sequences(batch, FEATURES, "host", "time", 3, pad=True)
    want = by_time(md.score_window(windows, model, mm).select("host", "time", "prediction"))
    np.testing.assert_allclose(by_time(made).prediction, want.prediction)
    warned = spark.read.parquet(str(tmp_path / "out" / "alerts"))
    assert 0 < warned.count() == made.where("prediction > 20").count()


def test_stream_of_forecasts_meets_the_actuals(spark, tmp_path):
    rows = [{"host": "h", "time": (START + dt.timedelta(seconds=s)).isoformat(), "actual": float(s), "prediction": s + 0.5} for s in range(40)]
    put(tmp_path / "p", "0.json", rows)
    schema = "host string, time timestamp, actual double, prediction double"
    stream = lambda: spark.readStream.schema(schema).json(str(tmp_path / "p"))
    out = run(live.stream_forecasts(stream(), stream()), tmp_path / "out", tmp_path / "state")
    got = out.collect()
    assert len(got) == 30 and all(r.actual - r.prediction == 9.5 for r in got)


def test_augment_job_and_table_sinks(spark, tmp_path):
    values = {c: F.col("id") * 1.0 for c in FEATURES}
    df = spark.range(12).select(
        F.lit("r").alias("run_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("time"), *[v.alias(c) for c, v in values.items()], (F.col("id") % 2).alias("Label")
    )
    out = jobs.augment(df, variations=2)
    write_augmented(out, str(tmp_path / "aug"))
    back = spark.read.parquet(str(tmp_path / "aug"))
    assert back.count() == 240 and set(back.columns) == {"run_id", "variation", "series", "k", "time", "Label", *FEATURES}
    assert back.where("Label NOT IN (0, 1)").count() == 0 and back.where("used_MB < 0").count() == 0
    data, _ = jobs.training_set(back, "series", "k", steps=60, horizon=10, span=1000)
    assert data.count() == 2 * (120 - 10 - 60) and data.first().pos is not None
    conn = df.select(
        F.lit("d").alias("day"), F.col("used_MB").alias("ts"), F.lit("h").alias("id_resp_h"), F.lit(1).alias("id_resp_p"), F.lit("tcp").alias("proto"),
        F.lit("1").alias("duration"), F.lit(1).alias("orig_bytes"), F.lit(2).alias("resp_bytes"), F.lit("RSTR").alias("conn_state"), F.lit("s").alias("server_name"),
    )
    write_report(jobs.report_sections(conn, conn), str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "servers")).first()["count"] == 12
    plan = jobs.load_plan(conn)
    assert plan["hours"].first().connections == 100 and plan["closed"].first().close_pct == 100.0
    assert plan["weights"].count() == 1


def spread(rows, seconds, files, folder):
    """Rows in files by their time and a shift of up to so many seconds each way forward."""
    rng = np.random.default_rng(9)
    at = lambda r: (dt.datetime.fromisoformat(r["timestamp"]) - START).total_seconds() + rng.uniform(0, seconds)
    keyed = sorted(((at(r), r) for r in rows), key=lambda k: k[0])
    for i in range(files):
        put(folder, f"{i}.json", [r for _, r in keyed[i * len(keyed) // files : (i + 1) * len(keyed) // files]])


def test_rows_out_of_order_wait_and_give_the_batch_s_rows(spark, tmp_path):
    rows = snapshots(n=20)
    spread(rows, 8, 6, tmp_path / "in")
    # The last file comes so late that the other hosts are silent: their rows go out.
    put(tmp_path / "in", "60.json", snapshots(hosts=("end",), n=1))
    source = live.snapshot_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    stream = live.stream_features(source, steps=4, late="8 seconds", silent="90 seconds", keep_late=True)
    got = run(stream, tmp_path / "out", tmp_path / "state")
    assert got.where("late IS NOT NULL").count() == 0
    batch = snapshot_rates(spark.createDataFrame(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    pd.testing.assert_frame_equal(by_time(got.where("host != 'end'"))[["host", "time", *FEATURES]], by_time(batch)[["host", "time", *FEATURES]])


def test_silent_hosts_are_forgotten(spark, tmp_path):
    rows = snapshots(hosts=("h",), n=8, reset=False)
    put(tmp_path / "in", "0.json", rows[:4])
    for i in (1, 2, 3, 4):
        put(tmp_path / "in", f"{i}.json", snapshots(hosts=("other",), n=3)[: i % 3 + 1])
    put(tmp_path / "in", "5.json", rows[4:])
    source = live.snapshot_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = live.start_predictions(live.stream_features(source, steps=3, silent="15 seconds"), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    query.awaitTermination()
    hosts = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    assert max(hosts) == 2 and hosts[4] == 1
    got = by_time(spark.read.parquet(str(tmp_path / "out")).where("host = 'h'"))
    # Forgotten after its fourth row, the host is new with the fifth.
    assert len(got) == 8 and got.total_packets_per_sec[4] == 0 and (got.total_packets_per_sec[[1, 2, 3, 5, 6, 7]] > 0).all()


def test_many_hosts_share_a_group_and_one_of_them_falls_silent(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "BUCKETS", 2, raising=False)
    rows = snapshots(hosts=[f"h{i}" for i in range(12)], n=8)
    gone = [r for r in snapshots(hosts=("gone",), n=8, reset=False)]
    at = lambda r: (dt.datetime.fromisoformat(r["timestamp"]) - START).total_seconds()
    part = lambda some, i: [r for r in some if 3 * i <= at(r) < 3 * (i + 1)]
    for i in range(4):
        put(tmp_path / "in", f"{i}.json", part(rows, i)[::-1] + (part(gone, 0) + part(gone, 1) if i == 0 else gone[4:] if i == 3 else []))
    source = live.snapshot_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = live.start_predictions(live.stream_features(source, steps=3, silent="5 seconds"), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    query.awaitTermination()
    # Python is called once for each group of a batch, however many hosts there are.
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress) <= 2
    got = by_time(spark.read.parquet(str(tmp_path / "out")))
    batch = by_time(snapshot_rates(spark.createDataFrame(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))))
    pd.testing.assert_frame_equal(got[got.host != "gone"][["host", "time", *FEATURES]].reset_index(drop=True), batch[["host", "time", *FEATURES]])
    one = got[got.host == "gone"].total_packets_per_sec.to_numpy()
    # Silent in the batches between, the host is new with its fifth row.
    assert len(one) == 8 and one[4] == 0 and (one[[1, 2, 3, 5, 6, 7]] > 0).all()


def test_a_window_of_one_step_is_the_row(spark, tmp_path):
    put(tmp_path / "in", "0.json", snapshots(n=3))
    put(tmp_path / "in", "1.json", snapshots(n=6)[3:6])
    source = live.snapshot_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = by_time(run(live.stream_features(source, steps=1), tmp_path / "out", tmp_path / "state"))
    assert len(got) == 9 and (np.stack(got.features) == got[FEATURES].to_numpy()).all()


def test_the_scaler_is_read_once_and_not_for_each_value(spark):
    cols = ["a", "b", "c"]
    mm = spark.createDataFrame([(0.0, 4.0, 1.0, 1.0, -2.0, 2.0)], "min_a double, max_a double, min_b double, max_b double, min_c double, max_c double")
    df = spark.createDataFrame([([1.0, 3.0, 0.0, 2.0, None, 2.0],), (None,)], "features array<double>")
    scaled = md.scale_steps(df, mm, cols)
    assert scaled.collect() == [([0.25, 2.0, 0.5, 0.5, None, 1.0],), (None,)]
    steps = next(x for x in scaled._jdf.queryExecution().optimizedPlan().toString().split("\n") if "transform(" in x)
    assert "array(" not in steps


def test_late_rows_come_as_they_were(spark, tmp_path):
    rows = snapshots(hosts=("h",), n=20)
    put(tmp_path / "in", "0.json", rows[:3] + rows[4:10])
    put(tmp_path / "in", "1.json", rows[10:])
    put(tmp_path / "in", "2.json", [rows[3]])
    source = live.snapshot_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = run(live.stream_features(source, steps=3, late="3 seconds", keep_late=True), tmp_path / "out", tmp_path / "state")
    late = got.where("late IS NOT NULL").select("late.*").collect()
    assert [r.asDict() for r in late] == [{**rows[3], "timestamp": dt.datetime.fromisoformat(rows[3]["timestamp"])}]
    assert got.where("late IS NULL").agg(F.max("dropped")).first()[0] == 0


def test_live_job_goes_on_after_a_stop_and_repeats_no_row(spark, tmp_path):
    rows = snapshots(n=24)
    at = lambda r: (dt.datetime.fromisoformat(r["timestamp"]) - START).total_seconds()
    put(tmp_path / "in", "0.json", [r for r in rows if at(r) < 18])
    batch = snapshot_rates(spark.createDataFrame(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    data, mm = jobs.training_set(batch, run="host", steps=3, horizon=2)
    model = md.fit_gbt(data.where("split = 'train'"), maxIter=2, maxDepth=2)
    md.save_model(model, str(tmp_path / "model"))

    def go():
        for q in live.live_job(spark, str(tmp_path / "in"), str(tmp_path / "model"), mm, str(tmp_path / "out"), str(tmp_path / "state"), threshold=20.0, steps=3, available_now=True):
            q.awaitTermination()

    go()
    put(tmp_path / "in", "1.json", [r for r in rows if at(r) >= 18] + [rows[2]])
    go()
    made = spark.read.parquet(str(tmp_path / "out" / "predictions"))
    windows = sr.sequences(batch, FEATURES, "host", "time", 3, pad=True)
    want = by_time(md.score_window(windows, model, mm).select("host", "time", "prediction"))
    assert len(want) == 48
    np.testing.assert_allclose(by_time(made).prediction, want.prediction)
    assert spark.read.parquet(str(tmp_path / "out" / "late")).count() == 1
    # A batch that is written again replaces what it wrote.
    part = made.where("batch = 0").drop("batch")
    stored = spark.createDataFrame(part.collect(), part.schema)
    live.write_batch({"predictions": stored}, str(tmp_path / "out"), 0)
    assert spark.read.parquet(str(tmp_path / "out" / "predictions")).count() == 48


def test_stream_of_counters_is_the_batch_pivot(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [{"host": f"h{rng.integers(3)}", "name": f"c{rng.integers(4)}", "seq": k, "value": int(rng.integers(1000))} for k in range(200)]
    order = rng.permutation(200)
    for i in range(7):
        put(tmp_path / "in", f"{i}.json", [rows[k] for k in order[i::7]])
    schema = "host string, name string, seq long, value long"
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    changes = live.stream_counters(files)
    live.start_counters(changes, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    got = live.latest_counters(spark, str(tmp_path / "out"), changes.schema)
    want = al.merge_counters(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
