"""End-to-end jobs made of the operators."""

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlat.operators import align as al
from netlat.operators import augment as au
from netlat.operators import connlog as cl
from netlat.operators import dataset as ds
from netlat.operators import load as ld
from netlat.operators import metrics as mt
from netlat.operators import model as md
from netlat.operators import scores as sc
from netlat.operators.series import CHUNK_ROWS, STORED_ROWS, chunk_windows, future_max, sequence_chunks, sequences, with_position
from netlat.session import settle
from netlat.schemas import CONN_SCHEMA, FEATURES, LABEL, SSL_SCHEMA, TARGET
from netlat.sources.logs import exists, optional, read_lines, read_optional_lines, read_zeek
from netlat.sources.tables import mem_usage, parse_mem_usage, read_feature_csv

# The file names of a run directory.
RUN_FILES = {
    "rtt": "rtt_log.txt",
    "retrans": "retrans_bpftrace.log",
    "packets": "packets_count.log",
    "mem_events": "mem_event.log",
    "throughput": "throughput.log",
    "mem_usage": "mem_usage.csv",
    "conn_fail": "conn_fail_stats.log",
    "sockets": "tcp_ss_detail.log",
    "vmstat": "vmstat.log",
    "softirqs": "softirqs.log",
    "iostat": "iostat.log",
    "throttle": "cpu_throttle.log",
    "timeline": "scenario_timeline.txt",
}
CONN_FIELDS = ["ts", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes", "conn_state"]


def report_sections(conn: DataFrame, ssl: DataFrame | None, tz: str = "UTC", n: int = 10) -> dict[str, DataFrame]:
    """The seven sections of the connection report, for every day at once."""
    sections = {
        "proto_port": cl.top_counts(conn, ["proto", "id_resp_p"], n, by="day"),
        "hours": cl.hour_profile(conn, "ts", tz, by="day"),
        "abnormal_states": cl.state_ranking(conn, by="day"),
        "transfers": cl.top_transfers(conn, n, by="day"),
        "response_sizes": cl.size_histogram(conn, "resp_bytes", n, by="day"),
        "mean_duration": cl.mean_unset_zero(conn, "duration", by="day", name="mean_duration"),
    }
    if ssl is not None:
        sections["servers"] = cl.top_counts(ssl, "server_name", n, by="day")
    return sections


def connection_report(spark: SparkSession, root: str, days: str = "*", tz: str = "UTC", n: int = 10) -> dict[str, DataFrame]:
    """Report over `root/<day>/conn.log` and, where present, `ssl.log`."""
    # Six sections read the rows, so the text is taken apart once.
    conn = settle(read_zeek(spark, f"{root}/{days}/conn.log", CONN_FIELDS, CONN_SCHEMA), "conn")
    ssl = optional(
        spark, f"{root}/{days}/ssl.log", _server_schema(), lambda p: read_zeek(spark, p, ["server_name"], SSL_SCHEMA)
    )
    return report_sections(conn, ssl, tz, n)


def _server_schema():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("day", T.StringType()), T.StructField("server_name", T.StringType())])


def feature_table(
    logs: dict[str, DataFrame], rule: str = "trailing", link_bps: int = 10**9, device: str | None = None,
    fill_first: bool = False, header_lines: int = 2,
) -> DataFrame:
    """One labelled row per run and second from the lines of the run logs.

    `logs` is keyed like RUN_FILES; `mem_usage` holds rows, the others lines. The
    table of seconds is written once the text has been read, since counters,
    positions and labels each pass over it again.
    """
    series = second_series(logs, rule, link_bps, header_lines)
    raw = settle(al.align(series, ["run_id", "time"], fill=None), "seconds")
    seconds = settle(al.align(second_rates(raw, fill_first), ["run_id", "time"]), "rates")
    placed = with_position(seconds, "run_id", "time", name="_pos")
    placed = al.zip_positional(placed, mt.run_queue_samples(logs["vmstat"]), pos="_pos")
    placed = al.zip_positional(placed, mt.disk_samples(logs["iostat"], device), pos="_pos")
    labelled = al.label_phases(placed, mt.phase_starts(logs["timeline"]))
    return labelled.select(
        "run_id", "time", *[F.col(c).cast("double").alias(c) for c in FEATURES], F.col(LABEL).cast("int").alias(LABEL)
    )


def second_series(
    logs: dict[str, DataFrame], rule: str = "trailing", link_bps: int = 10**9, header_lines: int = 2
) -> dict[str, DataFrame]:
    """The series with a clock, one row per second each; counters as they stand."""
    return {**mt.all_series(logs, rule, link_bps, header_lines), "memory": logs["mem_usage"]}


def second_rates(raw: DataFrame, fill_first: bool = False) -> dict[str, DataFrame]:
    """Series of one table of seconds: loss rate, and each counter's growth over
    the seconds that have it. Retransmits count only where packets were seen."""
    keys = ["run_id", "time"]
    has = lambda *cols: raw.where(" OR ".join(f"{c} IS NOT NULL" for c in cols)).select(*keys, *cols)
    plain = ["nic_usage_pct", "total_mem_events_per_sec", "Recv_Q_Bytes_max", "Send_Q_Bytes_max", "cwnd_min",
             "ssthresh_min", "used_MB", "available_MB", "RTT_ms_mean"]
    # A second in which only retransmits were logged is not a row.
    others = [c for c in raw.columns if c not in [*keys, "retrans_count"]]
    return {
        "plain": has(*others).select(*keys, *plain),
        "loss": mt.loss_columns(has("total_packets_per_sec", "retrans_count").where("total_packets_per_sec IS NOT NULL")),
        "connections": mt.connection_rates({"fails": has("fails"), "drops": has("drops")}, fill_first),
        "softirq": mt.softirq_rates(has("rx", "tx")),
        "throttle": mt.throttle_rates(has("cpu_throttle")),
    }


def run_features(spark: SparkSession, root: str, runs: str = "*", **options) -> DataFrame:
    """Feature table of every run directory below `root`. Missing logs are
    skipped, their columns are 0; without any log there is no run, which is an error."""
    at = lambda name: f"{root}/{runs}/{RUN_FILES[name]}"
    if not any(exists(spark, at(name)) for name in RUN_FILES):
        raise FileNotFoundError(f"no run log below {root}/{runs}")
    logs = {name: read_optional_lines(spark, at(name)) for name in RUN_FILES if name != "mem_usage"}
    empty = mem_usage(spark.createDataFrame([], "run_id string, timestamp string, used_MB bigint, available_MB bigint"))
    logs["mem_usage"] = optional(spark, at("mem_usage"), empty.schema, lambda p: parse_mem_usage(spark, p))
    return feature_table(logs, **options)


def augment(
    df: DataFrame, order="time", factor: int = 10, level: float = 0.02, variations: int = 1, seed: int = 0,
    span: float = 3600, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Augmented rows of a feature table; `time` is the nearest old row's time.

    `series` names each variation of a run and `k` orders its rows, so the result
    is ready for training_set(df, "series", "k").
    """
    out = au.augment_series(
        df, [*FEATURES, LABEL], ["time"], "run_id", order, factor, level, variations, seed, span, rows, store=settle
    )
    return out.withColumn("series", F.concat(F.lit("aug_v"), F.col("variation"), F.lit("_"), F.col("run_id")))


def augment_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Augmented rows of feature tables stored as CSV, in the order of the files."""
    return augment(read_feature_csv(spark, path), ["block", "line_no"], span=1, **options)


def _usable(df: DataFrame, run: str, order: str, cols: list[str], target: str, steps: int, horizon: int, span: float, rows: int) -> DataFrame:
    """Rows with a target, of series that give a window, numbered by `_at` of `_size`;
    stored once for all that follows."""
    with_target = future_max(df.select(run, order, *cols), target, run, order, horizon, span=span, rows=rows).dropna()
    placed = with_position(with_target, run, order, name="_at", span=span, size="_size")
    return settle(placed.where(F.col("_size") > steps), "usable")


def _ends(steps: int, keep_last: bool):
    """Whether a window ends at a row of _usable."""
    return F.col("_at") >= steps - 1 if keep_last else F.col("_at").between(steps - 1, F.col("_size") - 2)


def training_chunks(
    df: DataFrame,
    run: str = "run_id",
    order: str = "time",
    cols: list[str] = FEATURES,
    target: str = TARGET,
    steps: int = 60,
    horizon: int = 10,
    train: float = 0.8,
    folds: int = 3,
    gap: int = 0,
    fit_on: str = "all",
    keep_last: bool = False,
    span: float = 3600,
    rows: int = CHUNK_ROWS,
    stored: int = STORED_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """What training_set gives, as chunks of `stored` rows that hold each row about once,
    and the scaler. windows_of makes the windows."""
    usable = _usable(df, run, order, cols, target, steps, horizon, span, rows)
    ends = _ends(steps, keep_last)
    # Rows that end no window are numbered too, but not kept as ends.
    numbered = usable.withColumn("_nth", F.col("_at") - (steps - 1))
    split = ds.position_split(numbered, run, order, train, folds, gap, in_run="_nth", counted=usable.where(ends))
    keep = [F.col(order), F.col(target).alias("last_value"), "y_target", "pos", "split", "fold"]
    chunks = settle(sequence_chunks(split, cols, run, steps, keep, ends, "_at", stored), "chunks")
    if fit_on == "all":
        mm = ds.fit_minmax(usable, [*cols, "y_target"])
    else:
        mm = ds.fit_steps(chunk_windows(chunks, run, steps).where("split = 'train'"), cols, also="y_target")
    return chunks, settle(mm, "scaler")


def windows_of(
    chunks: DataFrame, mm: DataFrame, run: str = "run_id", order: str = "time", cols: list[str] = FEATURES, steps: int = 60
) -> DataFrame:
    """The scaled windows of training_chunks, made as the chunks are read."""
    scaled = ds.scale_steps(chunk_windows(chunks, run, steps), mm, cols, also="y_target")
    return scaled.select(run, order, "last_value", "features", "y_target", "pos", "split", "fold")


def training_set(
    df: DataFrame,
    run: str = "run_id",
    order: str = "time",
    cols: list[str] = FEATURES,
    target: str = TARGET,
    steps: int = 60,
    horizon: int = 10,
    train: float = 0.8,
    folds: int = 3,
    gap: int = 0,
    fit_on: str = "all",
    keep_last: bool = False,
    span: float = 3600,
    rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Scaled windows with their target, split by position, and the scaler.

    Steps and horizon count rows: on a table that was resampled 10 times, 60
    steps are 6 seconds. `fit_on="train"` fits the scaler on the rows of the
    training windows only; together with a gap of steps + horizon - 1 rows the
    test rows then stay unseen.
    """
    usable = _usable(df, run, order, cols, target, steps, horizon, span, rows)
    placed = usable.withColumn("last_value", F.col(target))
    if fit_on == "all":
        # Each row is scaled once, before it stands in many windows.
        mm = settle(ds.fit_minmax(usable, [*cols, "y_target"]), "scaler")
        placed = ds.scale(placed, mm, [*cols, "y_target"])
    windows = sequences(placed, cols, run, order, steps, keep_last=keep_last, pos="_at", rows=rows)
    windows = windows.withColumn("_at", F.col("_at") - (steps - 1))
    split = ds.position_split(windows, run, order, train, folds, gap, in_run="_at", counted=usable.where(_ends(steps, keep_last)))
    scaled = split
    if fit_on != "all":
        mm = settle(ds.fit_steps(split.where("split = 'train'"), cols, also="y_target"), "scaler")
        scaled = ds.scale_steps(split, mm, cols, also="y_target")
    return scaled.select(run, order, "last_value", "features", "y_target", "pos", "split", "fold"), mm


def train(df: DataFrame, grid: dict = md.GRID, parallelism: int = 1, store: str | None = None, **params):
    """Tune the boosted trees on the training rows; the winner is kept in the folder
    `store`, where evaluate and the live job find it again."""
    tuned = md.tune(df.where("split = 'train'"), grid, "fold", parallelism, **params)
    if store:
        md.save_model(tuned.bestModel, store)
    return tuned


def evaluate(df: DataFrame, models: dict, mm: DataFrame, every: int = 50) -> dict[str, DataFrame]:
    """Metrics and best model, every n-th row of the test set with all predictions
    (`samples`) and, of several models, which of the first two is better (`gap`). A model
    may be given as the folder it was kept in."""
    models = {name: md.load_model(df.sparkSession, m) if isinstance(m, str) else m for name, m in models.items()}
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    fitted = md.fit_models(train, models)
    metrics = md.compare(train, test, fitted, mm, persistence="last_value")
    some = md.predictions(test.where(F.col("pos") % every == 0), fitted)
    names = list(fitted)
    out = {"metrics": metrics, "best": sc.best_model(metrics)}
    out["samples"] = ds.unscale(some, mm, ["y_target", *names], "y_target").select("pos", "y_target", *names)
    if len(names) > 1:
        out["gap"] = sc.rmse_gap(metrics, names[0], names[1])
    return out


def importance(spark: SparkSession, model: Model, cols: list[str] = FEATURES, top: int | None = None) -> DataFrame:
    return sc.fold_importance(md.importance_table(spark, model), cols, top)


def load_plan(
    conn: DataFrame, ts: str = "ts", host: str = "server_name", state: str = "conn_state", closed=("RSTR", "RSTO", "REJ"),
    top: int = 6, tz: str = "UTC", day_ladders: dict | None = None,
) -> dict[str, DataFrame]:
    """Hourly connections, category weights and share of closed connections per
    day, from a connection log."""
    profile = cl.hour_profile(conn, ts, tz, by="day").select("day", "hour", F.col("count").alias("traffic"))
    return {
        "hours": ld.stress_ladder(profile, day_ladders=day_ladders),
        "weights": ld.category_weights(conn, host, top, by="day"),
        "closed": ld.closed_share(conn, state, list(closed), by="day"),
    }
