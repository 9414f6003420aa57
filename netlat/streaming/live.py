"""Live scoring: counter snapshots in, predictions and alerts out."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netlat.operators.align import merge_counters
from netlat.operators.model import load_model, score_window
from netlat.operators.rates import features_of
from netlat.operators.series import names
from netlat.operators.views import alerts
from netlat.schemas import COUNTERS, FEATURES, GAUGES, LEVELS, SNAPSHOT_SCHEMA

#: Windows made at a time.
SLICE = 5_000

_WHOLE = [*LEVELS, *COUNTERS]
# Numbers travel as arrays: each group's columns are made one by one in Python.
_MADE = "host string, us bigint, made array<double>, features array<double>, dropped bigint, late boolean, gauges array<double>, whole array<bigint>"
# Hosts are dealt by hash into so many groups, since Spark hands the groups of a batch to
# Python one by one, which takes milliseconds each however few its rows are.
BUCKETS = 1024
# Of the hosts of a group: the time up to which rows are out (NONE: no row yet), the latest
# time seen, when something last came, how many rows came too late, the counters of the
# last row out and the feature rows still in reach; then the rows that wait for earlier
# ones: the place of their host, times, gauges, whole numbers. Numbers are kept as bytes.
_KEPT = {"out_us": "<i8", "seen_us": "<i8", "due_ms": "<i8", "dropped": "<i8", "counters": "<i8", "recent": "<f8"}
_WAITING = {"of": "<i8", "us": "<i8", "gauges": "<f8", "whole": "<i8"}
_STATE = T.StructType([T.StructField("hosts", T.ArrayType(T.StringType()))] + [T.StructField(c, T.BinaryType()) for c in (*_KEPT, *(f"waiting_{c}" for c in _WAITING))])
NONE = np.iinfo(np.int64).min


def arrived() -> Column:
    """When the file of a row was last changed."""
    return F.col("_metadata.file_modification_time").alias("arrived")


def snapshot_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Snapshots from JSON files, with the time at which each `arrived`. The file limit
    bounds what one host can bring into one batch."""
    reader = spark.readStream.schema(SNAPSHOT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).select("*", arrived())


def _rates(gauges: np.ndarray, whole: np.ndarray, before: np.ndarray, seconds: np.ndarray, first: np.ndarray, link_bps: float, clip: bool) -> np.ndarray:
    """Feature matrix of snapshots, by the formulas of the batch form; `before` has the
    counters of the snapshot before each."""
    growth = whole[:, len(LEVELS) :] - before
    growth = np.maximum(growth, 0) if clip else growth
    now = {c: gauges[:, k] for k, c in enumerate(GAUGES)} | {c: whole[:, k] for k, c in enumerate(_WHOLE)}
    grown = {c: growth[:, k] for k, c in enumerate(COUNTERS)}

    def ratio(n, d, scale):
        n, d = np.asarray(n, float), np.asarray(d, float)
        return np.divide(n * scale, d, out=np.zeros_like(n), where=d > 0)

    made = features_of(now.get, grown.get, seconds, link_bps, ratio, lambda x: np.where(first, 0.0, x))
    return np.column_stack([np.asarray(made[c], dtype=float) for c in FEATURES])


def _microseconds(span: str) -> int:
    return int(pd.Timedelta(span) / pd.Timedelta("1us"))


def stream_features(
    snapshots: DataFrame, steps: int = 60, link_bps: float = 1e9, clip: bool = True, late: str = "0 seconds", silent: str = "1 hour",
    keep_late: bool = False,
) -> DataFrame:
    """Feature row and sliding window of each snapshot, kept per host.

    Spark lacks a row window over streams, so this is a stateful function. A row waits
    until its host has sent one that is `late` newer, so rows that come out of order
    by no more than that go out in order; with "0 seconds" rows go out at once, and
    only those of one micro-batch are put in order. A row older than the last one that
    went out comes too late and is dropped; `dropped` counts them, and with `keep_late`
    they come as they were in the column `late`, without features. The first row of a host fills the front of its first
    windows. Equal times count as one second, missing numbers as 0.

    The state of a host is the last row's counters, at most steps - 1 feature rows and the
    rows that wait; hosts are worked on by the group of BUCKETS they fall in. A host from which nothing has arrived while others sent for as long as
    `silent` gives its waiting rows and is forgotten; if it comes back it is new. Time
    for this is the column `arrived` if there is one, else that of the batch: no
    host's own clock, so no host can make another's rows late. Files more than
    `silent` older than the newest are left out by Spark, which counts their rows.
    """
    width, hold = len(FEATURES), _microseconds(late)
    clocked = snapshots if "arrived" in snapshots.columns else snapshots.withColumn("arrived", F.current_timestamp())
    zero = lambda cols, kind: F.array(*[F.coalesce(F.col(c), F.lit(0)).cast(kind) for c in cols])
    came_us = F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us")
    numbers = [zero(GAUGES, "double").alias("gauges"), zero(_WHOLE, "bigint").alias("whole")]
    bucket = F.pmod(F.xxhash64("host"), F.lit(BUCKETS)).cast("int").alias("bucket")
    narrow = clocked.select(bucket, "host", "arrived", F.coalesce(F.unix_millis("arrived"), F.lit(0)).alias("came"), came_us, *numbers)
    shapes = {"counters": (len(COUNTERS),), "recent": (steps - 1, width), "gauges": (len(GAUGES),), "whole": (len(_WHOLE),)}

    def read(kinds: dict[str, str], values, n: int) -> dict[str, np.ndarray]:
        return {c: np.frombuffer(v, kind).reshape(n, *shapes.get(c, ())) for (c, kind), v in zip(kinds.items(), values)}

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get if state.exists else ([], *[b""] * (len(_KEPT) + len(_WAITING)))
        at = {h: i for i, h in enumerate(stored[0])}
        old, held = len(at), stored[1 + len(_KEPT) :]
        kept, parts = read(_KEPT, stored[1:], old), [read(_WAITING, held, len(held[0]) // 8)]
        # Only numbers are gathered; a batch of the hosts is let go once read.
        for frame in () if state.hasTimedOut else batches:
            if frame["us"].isna().any():
                raise ValueError("a snapshot has no time")
            of = np.array([at.setdefault(None if pd.isna(h) else h, len(at)) for h in frame["host"]], np.int64)
            got = {"of": of, "us": frame["us"].to_numpy().astype(np.int64), "came": frame["came"].to_numpy().astype(np.int64)}
            parts.append(got | {"gauges": np.stack(frame["gauges"].to_list()), "whole": np.stack(frame["whole"].to_list())})
        hosts, n = np.array([*at, None], object)[:-1], len(at)
        fill = {"out_us": NONE, "seen_us": NONE}
        kept = {c: np.concatenate([v, np.full((n - old, *v.shape[1:]), fill.get(c, 0), v.dtype)]) for c, v in kept.items()}
        out_us, watermark = kept["out_us"], state.getCurrentWatermarkMs()

        heard, came = np.zeros(n, bool), np.zeros(n, np.int64)
        for k, part in enumerate(parts[1:], 1):
            heard[part["of"]] = True
            np.maximum.at(came, part["of"], part["came"])
            behind = part["us"] < out_us[part["of"]]
            if behind.any():
                np.add.at(kept["dropped"], part["of"][behind], 1)
                if keep_late:
                    of = part["of"][behind]
                    yield _frame(hosts[of], part["us"][behind], None, None, kept["dropped"][of], part["gauges"][behind], part["whole"][behind])
                part = {c: v[~behind] for c, v in part.items()}
            np.maximum.at(kept["seen_us"], part["of"], part["us"])
            parts[k] = part
        kept["due_ms"] = np.where(heard, np.maximum(came, watermark) + 1, kept["due_ms"])
        rows = {c: np.concatenate([p[c] for p in parts]) for c in _WAITING}
        order = np.lexsort((rows["us"], rows["of"]))
        silent_now = ~heard & (kept["due_ms"] < watermark)
        limit = np.where(silent_now, kept["seen_us"], kept["seen_us"] - hold)
        goes = rows["us"][order] <= limit[rows["of"][order]]
        go, stay = order[goes], order[~goes]
        of, us, whole = rows["of"][go], rows["us"][go], rows["whole"][go]
        made = np.zeros((0, width))
        if len(go):
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            mine, sizes = of[starts], np.diff(starts, append=len(go))
            new = out_us[mine] == NONE
            first = np.zeros(len(go), bool)
            first[starts] = new
            counters = whole[:, len(LEVELS) :]
            before, since = np.roll(counters, 1, axis=0), np.roll(us, 1)
            before[starts] = np.where(new[:, None], counters[starts], kept["counters"][mine])
            since[starts] = np.where(new, us[starts] - 1_000_000, out_us[mine])
            seconds = (us - since) / 1e6
            seconds[seconds == 0] = 1.0
            made = _rates(rows["gauges"][go], whole, before, seconds, first, link_bps, clip)
            # Each host's feature rows still in reach stand before its new ones.
            recent = np.where(new[:, None, None], made[starts][:, None, :], kept["recent"][mine])
            place = np.arange(len(go)) + np.repeat((steps - 1) * np.arange(1, len(starts) + 1), sizes)
            history = np.empty((len(go) + (steps - 1) * len(starts), width))
            history[place] = made
            reach = np.arange(steps - 1)
            history[(place[starts] - (steps - 1))[:, None] + reach] = recent
            ends = starts + sizes - 1
            kept["recent"][mine] = history[(place[ends] - (steps - 2))[:, None] + reach]
            kept["out_us"][mine], kept["counters"][mine] = us[ends], counters[ends]
        dropped = kept["dropped"]
        # A host that fell silent is forgotten.
        left = np.flatnonzero(~silent_now)
        if len(left):
            to = np.cumsum(~silent_now) - 1
            later = {c: v[stay] for c, v in rows.items()}
            later["of"] = to[later["of"]]
            values = [kept[c][left].astype(kind).tobytes() for c, kind in _KEPT.items()] + [later[c].astype(kind).tobytes() for c, kind in _WAITING.items()]
            state.update((hosts[left].tolist(), *values))
            state.setTimeoutTimestamp(max(int(kept["due_ms"][left].min()), watermark, 1))
        else:
            state.remove()
        # A window is steps rows wide, so only some are held at a time.
        for i in range(0, len(made), SLICE):
            windows = [history[p - (steps - 1) : p + 1].ravel() for p in place[i : i + SLICE]]
            some = of[i : i + SLICE]
            yield _frame(hosts[some], us[i : i + SLICE], made[i : i + SLICE], windows, dropped[some], None, None)

    out = narrow.withWatermark("arrived", silent).groupBy("bucket").applyInPandasWithState(
        update, _MADE, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    named = [F.get("made", F.lit(k)).alias(c) for k, c in enumerate(FEATURES)]
    shown = out.select("host", F.timestamp_micros("us").alias("time"), *named, "features", "dropped", *([_as_it_was().alias("late")] if keep_late else []))
    return shown


def _frame(host: np.ndarray, us: np.ndarray, made, windows, dropped: np.ndarray, gauges, whole) -> pd.DataFrame:
    rows = lambda values: [None] * len(us) if values is None else list(values)
    columns = {"host": host, "us": us, "made": rows(made), "features": rows(windows), "dropped": dropped}
    return pd.DataFrame(columns | {"late": made is None, "gauges": rows(gauges), "whole": rows(whole)})


def _as_it_was() -> Column:
    """A late row as a snapshot, null for others."""
    at = {c: F.get("gauges", F.lit(k)) for k, c in enumerate(GAUGES)} | {c: F.get("whole", F.lit(k)) for k, c in enumerate(_WHOLE)}
    at |= {"host": F.col("host"), "timestamp": F.timestamp_micros("us")}
    return F.when(F.col("late"), F.struct(*[at[c].alias(c) for c in SNAPSHOT_SCHEMA.names]))


def stream_score(features: DataFrame, model: Model, mm: DataFrame) -> DataFrame:
    """Prediction for each window: host, time, actual, prediction."""
    scored = score_window(features.where("late IS NULL") if "late" in features.columns else features, model, mm)
    return scored.select("host", "time", F.col("RTT_ms_mean").alias("actual"), "prediction")


def _trigger(writer: DataStreamWriter, available_now: bool) -> DataStreamWriter:
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")


def start_predictions(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to a parquet table."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return _trigger(writer, available_now).start(path)


def write_batch(tables: dict[str, DataFrame], out: str, batch: int) -> None:
    """The rows of one micro-batch, each table in a folder of the batch's number below
    its own. A batch that runs again replaces its folders, so it adds no row."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")


def start_tables(df: DataFrame, split, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write a stream as several tables at once. `split` makes them, by name, of the rows
    of a micro-batch, which are worked out once for all of them."""

    def each(rows: DataFrame, batch: int) -> None:
        rows.persist(StorageLevel.DISK_ONLY)
        try:
            write_batch(split(rows), out, batch)
        finally:
            rows.unpersist()

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    return _trigger(writer, available_now).start()


def live_tables(features: DataFrame, model: Model, mm: DataFrame, threshold: float = 800.0) -> dict[str, DataFrame]:
    """Of the rows of a batch: predictions, alerts, and the snapshots that came too late."""
    scored = stream_score(features, model, mm)
    return {"predictions": scored, "alerts": alerts(scored, threshold), "late": features.where("late IS NOT NULL").select("late.*")}


def live_job(
    spark: SparkSession,
    source: str,
    model: Model | str,
    mm: DataFrame,
    out: str,
    checkpoint: str,
    threshold: float = 800.0,
    steps: int = 60,
    link_bps: float = 1e9,
    available_now: bool = False,
    late: str = "0 seconds",
    silent: str = "1 hour",
    files_per_trigger: int = 1000,
) -> list[StreamingQuery]:
    """Score a folder of snapshots: predictions, alerts and late rows become three tables
    below `out`, all from one stream. Started again with its checkpoint, it goes on
    where it ended. `model` may be the folder that a training job kept it in."""
    model = load_model(spark, model) if isinstance(model, str) else model
    snapshots = snapshot_stream(spark, source, files_per_trigger)
    features = stream_features(snapshots, steps, link_bps, late=late, silent=silent, keep_late=True)
    return [start_tables(features, lambda rows: live_tables(rows, model, mm, threshold), out, checkpoint, available_now)]


def stream_counters(events: DataFrame, host="host", name: str = "name", seq: str = "seq", value: str = "value") -> DataFrame:
    """The newest value of each named counter of each host, as it changes (update mode).
    State is one row a host and counter; of equal sequence numbers the larger value is
    the newest."""
    newest = F.max(F.struct(F.col(seq), F.col(value)))
    return events.groupBy(*names(host), name).agg(newest.alias("_n")).select(*names(host), name, F.col(f"_n.{seq}").alias(seq), F.col(f"_n.{value}").alias(value))


def start_counters(changes: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write the changes of stream_counters by batch; latest_counters reads them."""
    writer = changes.writeStream.foreachBatch(lambda rows, batch: write_batch({"counters": rows}, out, batch))
    return _trigger(writer.option("checkpointLocation", checkpoint).outputMode("update"), available_now).start()


def latest_counters(spark: SparkSession, out: str, schema: T.StructType, counters: list[str] | None = None, host="host", name: str = "name",
                    seq: str = "seq", value: str = "value") -> DataFrame:
    """One row per host with the newest value of each counter, from the changes so far."""
    changes = spark.read.schema(schema).parquet(f"{out}/counters")
    return merge_counters(changes, host, name, seq, value, counters)


def stream_forecasts(predictions: DataFrame, actuals: DataFrame, horizon: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Join a stream of predictions to the values measured when they fall due, to the
    second: a host's several rows of one second meet each other."""
    second = lambda c: F.date_trunc("second", c).alias("time")
    due = predictions.select(
        "host", F.col("time").alias("made_at"), second(F.col("time") + F.expr(f"INTERVAL {horizon}")), "prediction"
    ).withWatermark("time", late)
    seen = actuals.select("host", second(F.col("time")), "actual").withWatermark("time", late)
    return due.join(seen, ["host", "time"])
