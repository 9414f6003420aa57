"""Operators against plain windows, numpy and pandas, and their plans."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netlat.functions import numbers as nb
from netlat.functions import text as tx
from netlat.operators import align as al
from netlat.operators import augment as au
from netlat.operators import connlog as cl
from netlat.operators import dataset as ds
from netlat.operators import load as ld
from netlat.operators import metrics as mt
from netlat.operators import scores as sc
from netlat.operators import series as sr
from netlat.operators import spread
from netlat.operators import views as vw
from netlat.plans import jobs
from netlat.schemas import FEATURES
from netlat.sources.tables import read_chunks, write_chunks

START = dt.datetime(2025, 11, 22, 12, 0, 0)


def series(spark, lengths, seed=1):
    """Runs of the given lengths, one row a second, with gaps in time."""
    rng = np.random.default_rng(seed)
    rows = []
    for r, n in enumerate(lengths):
        at = START
        for i in range(n):
            at += dt.timedelta(seconds=int(rng.integers(1, 400)))
            rows.append((f"run{r}", at, float(rng.normal(50, 20)), float(i), i % 2))
    return spark.createDataFrame(rows, "run_id string, time timestamp, x double, i double, Label int")


def pdf(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("rows", [100, 7, 5])
def test_chunks_give_the_same_as_whole_windows(spark, rows):
    df = series(spark, [500, 1, 3, 60])
    w = Window.partitionBy("run_id").orderBy("time")
    plain = df.select(
        "run_id",
        "time",
        F.avg("x").over(w.rowsBetween(-3, 0)).alias("a"),
        F.lead("x", 1).over(w).alias("b"),
        F.lag("x", 1).over(w).alias("c"),
    )
    columns = {
        "a": lambda w: F.avg("x").over(w.rowsBetween(-3, 0)),
        "b": lambda w: F.lead("x", 1).over(w),
        "c": lambda w: F.lag("x", 1).over(w),
    }
    got = sr.over_series(df, "run_id", "time", columns, back=3, ahead=1, rows=rows).select(plain.columns)
    pd.testing.assert_frame_equal(pdf(got, "run_id", "time"), pdf(plain, "run_id", "time"))


def test_chunk_must_be_longer_than_the_frame(spark):
    with pytest.raises(ValueError):
        sr.over_series(series(spark, [5]), "run_id", "time", {}, back=5, ahead=5, rows=10)


@pytest.mark.parametrize("span", [1, 60, 10**9])
def test_positions_do_not_depend_on_the_span(spark, span):
    df = sr.with_position(series(spark, [500, 1, 37]), "run_id", "time", span=span, size="size")
    assert df.where("pos <> i").count() == 0
    assert {(r.run_id, r.size) for r in df.select("run_id", "size").distinct().collect()} == {("run0", 500), ("run1", 1), ("run2", 37)}


def test_rows_without_a_time_come_first(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), ("a", 1)], "run_id string, t bigint")
    assert [r.t for r in sr.with_position(df, "run_id", "t").orderBy("pos").collect()] == [None, 1, 5]


def test_future_max_is_the_shifted_rolling_max(spark):
    df = series(spark, [50, 9])
    got = pdf(sr.future_max(df, "x", "run_id", "time", rows=20), "run_id", "time")
    want = pd.concat([g.x.rolling(10).max().shift(-10) for _, g in pdf(df, "run_id", "time").groupby("run_id")])
    np.testing.assert_allclose(got.y_target.astype(float), want)


def test_means_match_pandas(spark):
    df = series(spark, [80, 2])
    p = pdf(df, "run_id", "time")
    for back, ahead, roll in [(3, 0, dict(window=4)), (1, 1, dict(window=3, center=True))]:
        got = pdf(sr.rolling_mean(df, ["x", "Label"], "run_id", "time", back, ahead, rows=10), "run_id", "time")
        for c in ("x", "Label"):
            want = p.groupby("run_id")[c].transform(lambda s: s.rolling(min_periods=1, **roll).mean())
            np.testing.assert_allclose(got[c], want)


def test_sequence_counts_and_order(spark):
    df = series(spark, [70, 61, 60, 5])
    seq = sr.sequences(df, ["i", "x"], "run_id", "time", 60, rows=100)
    assert {r.run_id: r["count"] for r in seq.groupBy("run_id").count().collect()} == {"run0": 10, "run1": 1}
    for r in seq.where("run_id = 'run0'").collect():
        assert r.features[0::2] == [float(v) for v in range(r.pos - 59, r.pos + 1)]
    assert sr.sequences(df, ["i"], "run_id", "time", 60, keep_last=True).count() == 14
    padded = sr.sequences(df, ["i"], "run_id", "time", 60, pad=True, rows=100)
    assert padded.count() == 196 and padded.where("size(features) <> 60").count() == 0
    third = padded.where("run_id = 'run3' AND pos = 2").first()
    assert third.features == [0.0] * 58 + [1.0, 2.0]


@pytest.mark.parametrize("n", [1, 2, 3, 37, 200])
def test_upsampling_matches_interp(spark, n):
    df = series(spark, [n]).withColumn("text", F.col("i").cast("string"))
    got = pdf(au.upsample(df, ["x", "i"], "text", "run_id", "time", rows=20), "k")
    old = pdf(df, "time")
    grid = np.linspace(0, n - 1, 10 * n)
    assert list(got.k) == list(range(10 * n))
    np.testing.assert_allclose(got.x, np.interp(grid, np.arange(n), old.x), atol=1e-9)
    nearest = np.clip(np.round(grid).astype(int), 0, n - 1)
    assert list(got.text) == [str(float(v)) for v in nearest]


def augmented(old, level_free=True):
    """The same steps in pandas, without noise."""
    smooth = old[["x", "Label"]].rolling(4, min_periods=1).mean()
    n = len(old)
    grid = np.linspace(0, n - 1, 10 * n)
    out = {c: np.interp(grid, np.arange(n), smooth[c]) for c in smooth}
    x = pd.Series(out["x"]).rolling(3, min_periods=1, center=True).mean().clip(lower=0)
    return x, np.round(out["Label"])


@pytest.mark.parametrize("rows", [8, 1000])
def test_augmentation_without_noise(spark, rows):
    df = series(spark, [40, 2, 1]).withColumn("clock", F.col("time").cast("string"))
    got = pdf(au.augment_series(df, ["x", "Label"], "clock", "run_id", "time", level=0, variations=2, rows=rows), "run_id", "variation", "k")
    assert len(got) == 43 * 10 * 2
    for run, old in pdf(df, "run_id", "time").groupby("run_id"):
        x, label = augmented(old.reset_index(drop=True))
        for v in (1, 2):
            mine = got[(got.run_id == run) & (got.variation == v)]
            np.testing.assert_allclose(mine.x, x, atol=1e-9)
            np.testing.assert_array_equal(mine.Label, label)


def test_noise_is_repeatable_and_of_the_right_size(spark):
    df = series(spark, [300]).withColumn("k", F.col("i").cast("bigint"))
    one = pdf(au.add_noise(df, "run_id", ["x", "Label"], 0.5), "k")
    two = pdf(au.add_noise(df.repartition(7), "run_id", ["x", "Label"], 0.5), "k")
    pd.testing.assert_frame_equal(one, two)
    old = pdf(df, "k")
    noise = one.x - old.x
    assert abs(noise.std() / (np.std(old.x) * 0.5) - 1) < 0.15 and abs(noise.mean()) < 2
    assert (one.Label == old.Label).all()
    flat = df.withColumn("x", F.lit(3.0))
    assert 0 < pdf(au.add_noise(flat, "run_id", "x"), "k").x.std() < 0.001
    a = au.augment_series(df, ["x"], [], "run_id", "time", level=0.02, variations=2)
    wide = a.groupBy("k").agg(F.stddev_pop("x").alias("d"))
    assert wide.where("d > 0").count() > 2900


def test_scaling_and_its_inverse(spark):
    df = series(spark, [30]).withColumn("flat", F.lit(5.0))
    mm = ds.fit_minmax(df, ["x", "flat"])
    scaled = ds.scale(df, mm, ["x", "flat"])
    ends = scaled.agg(F.min("x"), F.max("x"), F.max("flat")).first()
    assert tuple(ends) == (0.0, 1.0, 0.0)
    back = pdf(ds.unscale(scaled, mm, "x", "x"), "time")
    np.testing.assert_allclose(back.x, pdf(df, "time").x)
    windows = sr.sequences(df, ["x", "flat"], "run_id", "time", 4)
    flat = ds.scale_steps(windows, mm, ["x", "flat"]).first().features
    raw = windows.first().features
    lo, hi = mm.first()["min_x"], mm.first()["max_x"]
    np.testing.assert_allclose(flat[0::2], [(v - lo) / (hi - lo) for v in raw[0::2]])
    assert flat[1::2] == [0.0] * 4
    fitted = ds.fit_steps(windows, ["x", "flat"], also="i").first()
    assert fitted["min_flat"] == 5.0 and fitted["max_i"] == 28.0


def test_split_by_position_over_all_runs(spark):
    df = series(spark, [50, 30, 20])
    got = pdf(ds.position_split(df, "run_id", "time", gap=7), "run_id", "time")
    assert list(got.pos) == list(range(100))
    assert (got.split == "train").sum() == 73 and (got.split == "gap").sum() == 7 and (got.split == "test").sum() == 20
    assert list(got[got.split == "train"].fold.value_counts(sort=False)) == [25, 24, 24]
    assert got[got.split == "train"].fold.is_monotonic_increasing and got[got.split != "train"].fold.isna().all()
    same = df.withColumn("run_id", F.concat(F.lit("a_name_that_begins_as_all_others_do_"), F.col("run_id")))
    assert list(pdf(ds.position_split(same, "run_id", "time"), "run_id", "time").pos) == list(range(100))


def test_forecasts_meet_on_seconds_of_drifting_clocks(spark):
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    at = lambda extra: (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 1.003 + extra).cast("decimal(18,6)"))).alias("time")
    rows = spark.range(40)
    made = rows.select(F.lit("h").alias("host"), at(0.0), F.col("id").cast("double").alias("prediction"))
    seen = rows.select(F.lit("h").alias("host"), at(0.4), F.col("id").cast("double").alias("actual"))
    assert al.align_forecast(made, seen).count() == 0
    got = al.align_forecast(made, seen, unit="second").collect()
    assert len(got) >= 28 and all(abs(r["actual"] - r["prediction"] - 10) <= 1 for r in got)


def test_deviation_of_large_values(spark):
    df = spark.range(300).select(
        F.lit("s").alias("run_id"), F.col("id").alias("time"), (F.lit(4e9) + (F.col("id") % 7) / 1000).alias("big"), ((F.col("id") % 7) / 1000).alias("small")
    )
    smooth = au._neighbours(df, ["run_id"], ["time"], ["big", "small"], [], 3, 3600, 100)
    big, small = au._deviations(smooth, ["run_id"], ["big", "small"], ["big", "small"], 10).first()["_sd"]
    assert small > 1e-4 and abs(big - small) < 1e-6


def test_unknown_counter_is_an_error(spark):
    df = spark.createDataFrame([("h", "a", 1, 2), ("h", "zz", 2, 3)], "host string, name string, seq int, value int")
    with pytest.raises(Exception, match="unknown counter: zz"):
        al.merge_counters(df, counters=["a", "b"]).collect()


def test_training_set(spark):
    lengths = [100, 90, 70, 20]
    df = series(spark, lengths)
    data, mm = jobs.training_set(df, cols=["x", "i"], target="x", steps=60, horizon=10, rows=100)
    p = pdf(data, "pos")
    # Ten rows lose their target, then each run gives its length minus the steps.
    assert len(p) == sum(max(0, n - 10 - 60) for n in lengths)
    assert list(p.pos) == list(range(len(p))) and (p.split == "train").sum() == int(len(p) * 0.8)
    values = np.concatenate([np.array(f) for f in p.features])
    assert values.min() >= 0 and values.max() <= 1
    old = pdf(df, "run_id", "time")
    run0 = old[old.run_id == "run0"].reset_index(drop=True)
    row = mm.first()
    target = run0.x[60:70].max()
    assert p.y_target[0] == pytest.approx((target - row["min_y_target"]) / (row["max_y_target"] - row["min_y_target"]))
    assert p.last_value[0] == run0.x[59]
    _, seen = jobs.training_set(df, cols=["x", "i"], target="x", fit_on="train", gap=5, rows=100)
    assert seen.first()["max_i"] <= row["max_i"]


@pytest.mark.parametrize("options", [{}, {"fit_on": "train", "gap": 5}, {"keep_last": True}])
def test_chunks_give_the_same_windows(spark, options):
    df = series(spark, [200, 90, 70, 20])
    what = {"cols": ["x", "i"], "target": "x", "steps": 60, "horizon": 10, **options}
    windows, mm = jobs.training_set(df, rows=100, **what)
    chunks, scaler = jobs.training_chunks(df, rows=100, stored=32, **what)
    assert scaler.first().asDict() == mm.first().asDict()
    got = jobs.windows_of(chunks, scaler, cols=["x", "i"], steps=60)
    assert got.columns == windows.columns
    key = lambda rows: sorted(map(tuple, ((r.run_id, r.time, r.last_value, tuple(r.features), r.y_target, r.pos, r.split, r.fold) for r in rows)))
    assert key(got.collect()) == key(windows.collect())


def test_chunks_hold_rows_about_once(spark, tmp_path):
    df = series(spark, [3000])
    chunks, mm = jobs.training_chunks(df, cols=["x", "i"], target="x", rows=1000, steps=60)
    write_chunks(chunks, mm, str(tmp_path))
    back, scaler = read_chunks(spark, str(tmp_path))
    assert back.agg(F.sum(F.size("held"))).first()[0] < 1.15 * 3000
    assert jobs.windows_of(back, scaler, cols=["x", "i"]).count() == 3000 - 10 - 60


def test_chunks_of_odd_tables(spark):
    kind = "run_id string, pos bigint, v double, extra string"
    empty = spark.createDataFrame([], kind)
    some = spark.createDataFrame([(None, 0, 1.0, "a"), (None, 1, None, "b"), (None, 2, 3.0, "c"), ("s", 0, 4.0, None)], kind)
    ends = F.col("pos") >= 1
    for rows in (1, 2, 10):
        assert sr.chunk_windows(sr.sequence_chunks(empty, "v", "run_id", 2, ["extra"], ends, rows=rows), "run_id", 2).count() == 0
        got = sr.chunk_windows(sr.sequence_chunks(some, "v", "run_id", 2, ["extra"], ends, rows=rows), "run_id", 2).collect()
        assert sorted((r.run_id, r.extra, r.features) for r in got) == [(None, "b", [1.0, None]), (None, "c", [None, 3.0])]


def test_labels_follow_the_phase(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("a", at(s)) for s in range(10)] + [("b", at(3)), ("a", START.replace(hour=23, minute=59, second=59))], "run_id string, time timestamp")
    phases = spark.createDataFrame([("a", at(2), 1), ("a", at(5), 0), ("a", at(7), 1)], "run_id string, start timestamp, label int")
    for span in (1, 2, 3600, 10**6):
        got = {(r.run_id, r.time): r.Label for r in al.label_phases(rows, phases, span=span).collect()}
        assert len(got) == 12
        assert [got[("a", at(s))] for s in range(10)] == [0, 0, 1, 1, 1, 0, 0, 1, 1, 1]
        assert got[("b", at(3))] == 0 and got[("a", START.replace(hour=23, minute=59, second=59))] == 0


def test_align_uses_one_shuffle_for_many_series(spark):
    base = series(spark, [20])
    many = {f"s{i}": base.select("run_id", "time", F.col("x").alias(f"c{i}")).where(F.col("i") % (i + 2) == 0) for i in range(5)}
    out = al.align(many, ["run_id", "time"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert out.where("c0 = 0").count() > 0


def test_zip_cuts_and_pads(spark):
    base = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "run_id string, time int")
    samples = spark.createDataFrame([("a", 0, 5, 10), ("a", 7, 1, 20), ("b", 0, 1, 30), ("b", 0, 2, 40)], "run_id string, block int, line_no int, v int")
    got = [tuple(r) for r in al.zip_positional(base, samples).orderBy("run_id", "time").collect()]
    assert got == [("a", 1, 10), ("a", 2, 20), ("a", 3, 0), ("b", 1, 30)]


def test_text_expressions(spark):
    df = spark.createDataFrame([(" \x1b[1;31m12:00:01 rtt:1.5/0.7 cwnd:10 rtt:2.5 cwnd:4 \x1b[0m",), ("NET_RX: 1 2 x3",)], ["v"])
    one, two = df.select(
        tx.strip_ansi("v").alias("s"),
        tx.clock("v").alias("c"),
        tx.kv("v", "cwnd").alias("first"),
        tx.kv("v", "rtt", all=True, number=r"[\d.]+", lead=r"\s+", type="double").alias("all"),
        tx.int_sum("v").alias("any"),
        tx.int_sum("v", whole_tokens=True).alias("whole"),
        tx.token("v", -1, type="string").alias("last"),
        tx.token("v", 9).alias("none"),
    ).collect()
    assert one.s == "12:00:01 rtt:1.5/0.7 cwnd:10 rtt:2.5 cwnd:4"
    assert (one.c, one["first"], one["all"]) == ("12:00:01", 10, [1.5, 2.5])
    assert (two.any, two.whole, two["last"], two.none) == (6, 3, "x3", None)


def test_number_expressions(spark):
    sizes = [0, 1023, 1024, 1048576, 1073741824, 16000]
    df = spark.createDataFrame([(s,) for s in sizes], "b bigint")
    got = [r[0] for r in df.select(nb.human_bytes("b")).collect()]
    assert got == ["0B", "1023B", "1.00KB", "1.00MB", "1.00GB", "15.62KB"]
    df = spark.createDataFrame([(0,), (5,), (999,), (2500,)], "n bigint")
    assert [r[0] for r in df.select(nb.bar("n")).collect()] == ["", "*", "*", "**"]
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (-1.0, -1.0)], "n double, d double")
    assert [tuple(r) for r in df.select(nb.ratio("n", "d", 100), nb.clip0("n")).collect()] == [(0.0, 1.0), (25.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame([("-",), ("3",), (None,), ("x",)], "s string")
    assert df.select(F.avg(nb.number_or_zero("s"))).first()[0] == 0.75


def test_equal_counts_rank_by_descending_text(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("a",), ("d",)], ["k"])
    assert [r.k for r in cl.top_counts(df, "k", 3).collect()] == ["b", "a", "d"]


def test_weighted_pick_reaches_every_category(spark):
    weights = spark.createDataFrame([("d", "x", 2, 1), ("d", "y", 3, 2)], "day string, name string, weight bigint, place int")
    draws = spark.createDataFrame([("d", i) for i in range(1, 8)] + [("e", 1)], "day string, r bigint")
    got = {(r.day, r.r): r.name for r in ld.weighted_pick(draws, weights, "r", "none", "day").collect()}
    assert [got[("d", i)] for i in range(1, 8)] == ["x"] * 2 + ["y"] * 3 + ["none"] * 2 and got[("e", 1)] == "none"


def test_request_mix_shares(spark):
    weights = spark.createDataFrame([("d", "x", 30, 1), ("d", "y", 70, 2)], "day string, name string, weight bigint, place int")
    requests = spark.range(20000).select(F.lit("d").alias("day"), F.col("id").alias("n"))
    mix = ld.request_mix(requests, weights, "day", "n", "x", 36, [(10, "heavy"), (40, "mid")])
    share = lambda c: mix.where(c).count() / 20000
    assert abs(share("host = 'x'") - 0.3) < 0.02 and abs(share("connection = 'close'") - 0.36) < 0.02
    assert abs(share("request = 'heavy'") - 0.1) < 0.02 and abs(share("request = 'mid'") - 0.3) < 0.02


def test_category_weights_keep_the_total(spark):
    rows = spark.createDataFrame([(c,) for c in "aaabbcd"], ["k"])
    got = [tuple(r) for r in ld.category_weights(rows, "k", 2).orderBy("place").collect()]
    assert got == [("a", 3, 1), ("b", 2, 2), ("other", 2, 3)]
    assert ld.category_weights(rows, "k", 9).count() == 4


def test_metrics_match_their_formulas(spark):
    rng = np.random.default_rng(3)
    y, p = rng.uniform(-5, 100, 200), rng.uniform(-20, 100, 200)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p, "q": y}))
    m = {r.model: r for r in sc.regression_metrics(sc.evaluation_rows(df, "y", ["p", "q"]), "y", ["p", "q"]).collect()}
    keep = y > 0
    y, p = y[keep], np.maximum(p[keep], 0)
    assert m["p"].mae == round(np.mean(np.abs(y - p)), 4)
    assert m["p"].rmse == round(np.sqrt(np.mean((y - p) ** 2)), 4)
    assert m["p"].mape == round(np.mean(np.abs((y - p) / (y + 1e-10))) * 100, 2)
    assert m["p"].r2 == round(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), 4)
    assert m["q"].r2 == 1.0
    both = spark.createDataFrame(list(m.values()))
    assert sc.best_model(both).first().model == "q"
    assert tuple(sc.rmse_gap(both, "p", "q").first()) == ("q", round(m["p"].rmse, 2))


def test_importance_keeps_the_sum(spark):
    df = spark.range(1200).select(F.col("id").alias("pos"), F.rand(1).alias("importance"))
    folded = sc.fold_importance(df, FEATURES)
    assert folded.count() == 20
    assert folded.agg(F.sum("importance")).first()[0] == pytest.approx(df.agg(F.sum("importance")).first()[0])


def test_views(spark):
    df = series(spark, [40, 2])
    recent = {r.run_id: r for r in vw.recent_values(df, ["i"], "run_id", "time").collect()}
    assert (recent["run0"].ago_0, recent["run0"].ago_3, recent["run1"].ago_1, recent["run1"].ago_2) == (39.0, 36.0, 0.0, None)
    wide = {r.run_id: r for r in vw.history_pivot(df, ["i"], "run_id", "time").collect()}
    assert wide["run0"].ago_29 == 10.0 and wide["run1"].ago_29 is None
    assert vw.history_pivot(df, ["i"], "run_id", "time", fill=0.0).where("ago_29 IS NULL").count() == 0
    assert {r.i for r in vw.latest_row(df, "run_id", "time").collect()} == {39.0, 1.0}
    p = spark.createDataFrame([(800.0,), (800.1,)], ["prediction"])
    assert vw.alerts(p).count() == 1
    assert vw.alerts(p, spark.createDataFrame([(1.0,)], ["t"])).count() == 2
    assert vw.as_json(p).first()[0] == '{"prediction":800.0}'


def test_last_rows_are_limited_before_the_shuffle(spark):
    plan = sr.last_n(series(spark, [40]), "run_id", "time", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_declared_columns(spark):
    df = spark.createDataFrame([(1, None)], "b int, a double")
    assert al.conform(df, ["a", "b", "c"]).first().asDict() == {"a": 0.0, "b": 1, "c": 0}
    with pytest.raises(ValueError, match="missing columns: x"):
        al.require_columns(df, ["a", "x"])
    assert al.require_columns(df, ["a", "b"]).columns == ["a", "b"]
    assert df.select(nb.kb_to_mb(F.lit(2048))).first()[0] == 2.0


def test_reject_counts(spark):
    lines = spark.createDataFrame([("r", "f", "@[a]: 1"), ("r", "f", "@[a]: x"), ("r", "f", "noise")], "run_id string, file string, value string")
    got = mt.reject_counts(lines, tx.counter_value("value").isNotNull()).first()
    assert (got.accepted, got.rejected) == (1, 2)


def test_text_order_is_refused(spark):
    with pytest.raises(ValueError, match="order by a time"):
        sr.with_position(spark.createDataFrame([("a", "12:00:00")], "r string, t string"), "r", "t")


def test_no_task_gets_a_whole_hot_run(spark):
    """One run holds nearly all rows; its windows still spread over many groups."""
    hot = spark.range(40000).select(
        F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("run_id"),
        F.timestamp_seconds(F.col("id")).alias("time"),
        (F.col("id") % 7).cast("double").alias("x"),
    )
    seen = {"size": lambda w: F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    largest = sr.over_series(hot, "run_id", "time", seen, back=3, rows=1000).agg(F.max("size")).first()[0]
    assert largest == 1003
    assert sr.rolling_mean(hot, "x", "run_id", "time", 3, rows=1000).count() == 40000


def test_hot_series_are_joined_in_pieces(spark, monkeypatch):
    """One series with a third of all rows, and others."""
    monkeypatch.setattr(spread, "LEAST", 10)
    rows = [("hot" if k % 3 == 0 else f"s{k % 40}", k) for k in range(3000)] + [(None, 7)]
    df = spark.createDataFrame(rows, "run string, k long")
    small = df.groupBy("run").agg(F.count("*").alias("n"))
    sizes = small.withColumnRenamed("n", "_n")
    hot = {r["run"]: r["_pieces"] for r in spread.pieces(sizes, "run", share=20).collect()}
    assert hot == {"hot": 7}
    for how in ("inner", "left", "left_semi"):
        got = spread.spread_join(df, small.where("run != 's1'"), "run", F.col("k"), how, share=20)
        want = df.join(small.where("run != 's1'"), "run", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    joined = spread.spread_join(df.where("run = 'hot'").repartition(4), small, "run", F.col("k"), share=20)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in plan


def test_pick_among_many_categories(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST", 5)
    rng = np.random.default_rng(4)
    weight = np.where(rng.random(100_000) < 0.001, 5000, rng.integers(0, 4, 100_000))
    groups = [("big", f"c{k:06}", int(w), k) for k, w in enumerate(weight)] + [("few", "a", 3, 1), ("few", "b", 0, 2), ("few", "c", 2, 3)]
    weights = spark.createDataFrame(groups, "day string, name string, weight long, place long")
    total = int(weight.sum())
    draws = [("big", int(d)) for d in rng.integers(-2, total + 3, 3000)] + [("few", d) for d in range(-1, 8)] + [("none", 1), (None, 1), ("few", None)]
    at = spark.createDataFrame(draws, "day string, draw long")
    got = ld.weighted_pick(at, weights, "draw", "other", "day")
    reach = {"big": np.cumsum(weight), "few": np.cumsum([3, 0, 2])}
    names = {"big": [g[1] for g in groups if g[0] == "big"], "few": ["a", "b", "c"]}

    def pick(day, d):
        if day not in reach or d is None:
            return "other"
        # The first category with a weight whose running sum reaches the draw.
        k = int(np.searchsorted(reach[day], max(d, 1)))
        return names[day][k] if k < len(reach[day]) else "other"

    assert sorted(map(str, ((r.day, r.draw, r.name) for r in got.collect()))) == sorted(str((g, d, pick(g, d))) for g, d in draws)
