"""One query per operator over the given tables, each with its plain SQL.

Text is built from the tables only to be parsed again; the SQL works on the
columns the text was made of.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlat.functions import text as tx
from netlat.operators import align as al
from netlat.operators import augment as au
from netlat.operators import connlog as cl
from netlat.operators import dataset as ds
from netlat.operators import load as ld
from netlat.operators import metrics as mt
from netlat.operators import model as md
from netlat.operators import scores as sc
from netlat.operators import series as sr
from netlat.operators import snapshots as sn
from netlat.operators import views as vw
from netlat.operators.rates import snapshot_rates
from netlat.plans import jobs
from netlat.plans.standins import (
    EVENT_TYPES,
    as_snapshots,
    connection_files,
    events,
    hourly,
    hourly_by_type,
    log_lines,
    order_files,
    profile,
    table,
)
from netlat.schemas import COUNTERS, FEATURES
from netlat.session import scratch_path, settle
from netlat.sources.tables import read_dataset, write_dataset, write_report
from netlat.streaming import live

QUERIES = {}
ORACLE = {}
# Raw events of one series are cut into spans of a minute.
SPAN = 60


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def epoch(c) -> F.Column:
    return F.unix_seconds(c).alias(c if isinstance(c, str) else "time")


def r6(c) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


def bigs(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, like the SQL side."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


HOURLY = """SELECT event_type AS run_id, date_trunc('hour', ts) AS time, count(*) AS n, sum(value) AS total,
  avg(value) AS mean, max(value) AS peak FROM events GROUP BY 1, 2"""
BY_TYPE = (
    "SELECT 'block' || CAST(floor(dayofyear(time) / 10) AS BIGINT) AS run_id, * FROM (SELECT date_trunc('hour', ts) AS time, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES)
    + " FROM events GROUP BY 1)"
)
PROFILE = """SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS traffic
  FROM events GROUP BY 1, 2"""
SECONDS = "CAST(epoch(time) AS BIGINT) AS time"


# ---- connection reports ----------------------------------------------------------


@query("""SELECT l_returnflag AS proto, l_suppkey AS id_resp_p, count(*) AS count FROM lineitem GROUP BY 1, 2
ORDER BY count DESC, proto DESC, CAST(id_resp_p AS VARCHAR) DESC LIMIT 10""")
def conn_top_proto_port(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("proto"), F.col("l_suppkey").alias("id_resp_p")
    )
    return cl.top_counts(rows, ["proto", "id_resp_p"], 10)


@query("""SELECT regexp_extract(url, 'https?://([^/:?#]+)', 1) AS server_name, count(*) AS count FROM pages GROUP BY 1
ORDER BY count DESC, server_name DESC LIMIT 10""")
def conn_top_server(spark, sf):
    host = F.regexp_extract("url", "https?://([^/:?#]+)", 1).alias("server_name")
    return cl.top_counts(table(spark, sf, "pages").select(host), "server_name", 10)


@query("""SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS count,
  repeat('*', greatest(1, count(*) // 100)) AS bar FROM events GROUP BY 1 ORDER BY 1""")
def conn_hour_profile(spark, sf):
    return cl.hour_profile(events(spark, sf), "ts", per=100)


@query("""SELECT CAST(hour(ts + INTERVAL 9 HOUR) AS BIGINT) AS hour, count(*) AS count,
  repeat('*', greatest(1, count(*) // 100)) AS bar FROM events GROUP BY 1 ORDER BY 1""")
def conn_hour_profile_zone(spark, sf):
    seconds = events(spark, sf).select((F.unix_micros("ts") / 1e6).alias("ts"))
    return cl.hour_profile(seconds, "ts", tz="Asia/Seoul", per=100)


@query("""SELECT event_type AS conn_state, count(*) AS count FROM events WHERE event_type NOT LIKE '%view%'
GROUP BY 1 ORDER BY 2 DESC, 1 DESC""")
def conn_abnormal_states(spark, sf):
    return cl.state_ranking(events(spark, sf).withColumnRenamed("event_type", "conn_state"), normal="view")


def _human(c):
    return f"""CASE WHEN {c} >= 1073741824 THEN printf('%.2fGB', {c} / 1073741824)
  WHEN {c} >= 1048576 THEN printf('%.2fMB', {c} / 1048576) WHEN {c} >= 1024 THEN printf('%.2fKB', {c} / 1024)
  ELSE CAST({c} AS VARCHAR) || 'B' END"""


_TRANSFERS = """SELECT CAST(o_orderkey AS VARCHAR) AS host, CAST(round(o_totalprice * 10000) AS BIGINT) AS o,
  CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_custkey * 1000 END AS r, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
  CAST(year(o_orderdate) AS VARCHAR) AS day FROM orders"""


def _transfers(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(
        F.year("o_orderdate").cast("string").alias("day"),
        F.col("o_orderkey").cast("string").alias("id_resp_h"),
        F.round(F.col("o_totalprice") * 10000).cast("bigint").cast("string").alias("orig_bytes"),
        F.when(F.col("o_orderkey") % 10 == 0, "-").otherwise((F.col("o_custkey") * 1000).cast("string")).alias("resp_bytes"),
        F.unix_seconds("o_orderdate").alias("ts"),
    )


@query(f"""SELECT o + r AS total_bytes, {_human('(o + r)')} AS total_size, host, {_human('o')} AS client_tx,
  {_human('r')} AS server_tx, ts FROM ({_TRANSFERS}) ORDER BY total_bytes DESC, host DESC LIMIT 10""")
def conn_top_transfers(spark, sf):
    return cl.top_transfers(_transfers(spark, sf))


@query(f"""SELECT day, rank, o + r AS total_bytes, {_human('(o + r)')} AS total_size, host, {_human('o')} AS client_tx,
  {_human('r')} AS server_tx, ts FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY o + r DESC, host DESC) AS rank
  FROM ({_TRANSFERS})) WHERE rank <= 10""")
def conn_daily_transfers(spark, sf):
    return bigs(cl.top_transfers(_transfers(spark, sf), by="day"))


@query("""SELECT CAST(trunc(l_extendedprice * 100 / 1024 / 1024) AS BIGINT) || 'MB' AS size, count(*) AS count
FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 10""")
def conn_size_histogram(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_extendedprice") * 100).alias("resp_bytes"))
    return cl.size_histogram(rows, "resp_bytes")


@query("""SELECT l_linestatus AS day, round(avg(CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE l_quantity END), 6) AS mean_duration
FROM lineitem GROUP BY 1""")
def conn_mean_duration(spark, sf):
    text = F.when(F.col("l_orderkey") % 10 == 0, "-").otherwise(F.col("l_quantity").cast("string"))
    rows = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("day"), text.alias("duration"))
    return cl.mean_unset_zero(rows, "duration", by="day", name="mean_duration").select("day", r6("mean_duration"))


@query("""SELECT * FROM (SELECT day, user_id, count, row_number() OVER (PARTITION BY day ORDER BY count DESC,
  CAST(user_id AS VARCHAR) DESC) AS rank FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS count
  FROM events GROUP BY 1, 2)) WHERE rank <= 10""")
def conn_daily_topk(spark, sf):
    rows = events(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    return bigs(cl.top_counts(rows, "user_id", 10, by="day"))


_LOGGED = """SELECT CAST(year(o_orderdate) AS VARCHAR) AS day, o_orderpriority AS proto, o_custkey % 50 AS id_resp_p FROM orders"""


@query(f"""SELECT day, proto, CAST(id_resp_p AS BIGINT) AS id_resp_p, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY day
  ORDER BY count DESC, proto DESC, CAST(id_resp_p AS VARCHAR) DESC) AS rank
  FROM (SELECT day, proto, id_resp_p, count(*) AS count FROM ({_LOGGED}) GROUP BY 1, 2, 3)) WHERE rank <= 10""")
def report_increments(spark, sf):
    """The report of log files written from the orders, a day after the other."""
    orders = table(spark, sf, "orders")
    rows = orders.select(
        F.year("o_orderdate").cast("string").alias("day"),
        F.unix_seconds("o_orderdate").cast("double").alias("ts"),
        F.col("o_custkey").cast("string").alias("id.resp_h"),
        (F.col("o_custkey") % 50).cast("int").alias("id.resp_p"),
        F.col("o_orderpriority").alias("proto"),
        F.lit(None).cast("double").alias("duration"),
        F.col("o_orderkey").alias("orig_bytes"),
        F.col("o_custkey").alias("resp_bytes"),
        F.col("o_orderstatus").alias("conn_state"),
    )
    logs, out = scratch_path(spark, "conn-logs"), scratch_path(spark, "report")
    connection_files(rows, logs)
    for days in ("*[02468]", "*[13579]"):
        write_report(jobs.connection_report(spark, logs, days), out)
    return bigs(spark.read.parquet(f"{out}/proto_port").withColumn("day", F.col("day").cast("string")))


# ---- parsing ---------------------------------------------------------------------

CLOCKED = "yyyy-MM-dd HH:mm:ss"
RULED = "'===== 'yyyy-MM-dd HH:mm:ss' ====='"
RULED_FRACTION = "'===== 'yyyy-MM-dd HH:mm:ss.SSS' ====='"
ALL = "true"


@query("""SELECT event_type AS run_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time,
  CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY 1, 2""")
def parse_section_sum(spark, sf):
    green = F.when(F.col("event_id") % 7 == 0, "\x1b[32m").otherwise("")
    text = F.concat(green, F.lit("@["), F.col("user_id"), F.lit(":1]: "), F.floor("value"))
    lines = log_lines(events(spark, sf), "packets_count.log", [(text, ALL)], CLOCKED)
    lines = lines.withColumn("value", tx.strip_ansi("value"))
    return mt.sum_per_second(lines, "total").select("run_id", epoch("time"), "total")


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS quantity, round(sum(l_extendedprice), 2) AS price
FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1""")
def parse_positions(spark, sf):
    bad = F.when(F.col("l_orderkey") % 5 == 0, "bad").otherwise(F.col("l_quantity").cast("string"))
    text = F.concat_ws(" ", "l_orderkey", "l_partkey", bad, F.lit(" "), "l_extendedprice")
    rows = table(spark, sf, "lineitem").select("l_returnflag", text.alias("value"))
    rows = rows.select("l_returnflag", tx.token("value", 2).alias("q"), tx.token("value", -1).alias("p"))
    rows = rows.where(F.col("q").isNotNull() & F.col("p").isNotNull())
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("q"), 6).alias("quantity"), F.round(F.sum("p"), 2).alias("price")
    )


@query("""SELECT event_type AS run_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time,
  coalesce(max(CASE WHEN event_id % 5 <> 0 THEN user_id END), 0) AS "Recv_Q_Bytes_max",
  coalesce(max(CASE WHEN event_id % 5 <> 0 THEN event_id END), 0) AS "Send_Q_Bytes_max",
  coalesce(min(event_id % 31), 0) AS cwnd_min, coalesce(min(CASE WHEN event_id % 2 = 0 THEN user_id END), 0) AS ssthresh_min
FROM events GROUP BY 1, 2""")
def parse_kv_minmax(spark, sf):
    bad = F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("user_id").cast("string"))
    sockets = F.concat_ws(" ", F.lit("ESTAB"), bad, "event_id", F.lit("10.0.0.1:80 10.0.0.2:5000"))
    some = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" ssthresh:"), "user_id")).otherwise("")
    detail = F.concat(F.lit("\t cubic rtt:1.5/0.7 cwnd:"), F.col("event_id") % 31, some)
    lines = log_lines(events(spark, sf), "tcp_ss_detail.log", [(sockets, ALL), (detail, ALL)], RULED)
    return mt.socket_extremes(lines.withColumn("value", tx.strip_ansi("value"))).withColumn("time", F.unix_seconds("time"))


@query("""SELECT event_type AS run_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time,
  arg_max(user_id + event_id + CAST(floor(value) AS BIGINT), ts) AS rx,
  coalesce(arg_max(user_id + 5, ts) FILTER (event_id % 2 = 0), 0) AS tx FROM events GROUP BY 1, 2""")
def parse_intlist_sum(spark, sf):
    rx = F.concat_ws("   ", F.lit("NET_RX:"), "user_id", "event_id", F.floor("value").cast("string"))
    tx_ = F.concat_ws("   ", F.lit("NET_TX:"), "user_id", F.lit("5"))
    lines = log_lines(
        events(spark, sf), "softirqs.log", [(rx, ALL), (tx_, F.col("event_id") % 2 == 0)], RULED_FRACTION
    )
    return mt.softirq_sums(lines).select("run_id", epoch("time"), "rx", "tx")


@query("""WITH s AS (SELECT event_type AS run_id, date_trunc('hour', ts) AS time,
  coalesce(arg_max(event_id * 1000, ts) FILTER (event_id % 2 = 0), 0) + arg_max(user_id * 1000, ts) AS bytes
  FROM events GROUP BY 1, 2)
SELECT run_id, CAST(epoch(time) AS BIGINT) AS time, round(bytes * 8 / 1e9 * 100, 6) AS nic_usage_pct FROM s""")
def parse_nic_usage(spark, sf):
    sent = F.concat(F.lit("@tx_bytes: "), F.col("event_id") * 1000)
    got = F.concat(F.lit("@rx_bytes: "), F.col("user_id") * 1000)
    lines = log_lines(events(spark, sf), "throughput.log", [(sent, F.col("event_id") % 2 == 0), (got, ALL)], CLOCKED)
    return mt.nic_usage(lines).select("run_id", epoch("time"), r6("nic_usage_pct"))


@query("""SELECT event_type AS run_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS time,
  round(avg(value), 6) AS "RTT_ms_mean" FROM events WHERE event_id % 6 <> 0 GROUP BY 1, 2""")
def parse_mean_per_second(spark, sf):
    ms = F.when(F.col("event_id") % 6 == 0, "-").otherwise(F.col("value").cast("string"))
    text = F.concat_ws(" ", F.date_format("ts", CLOCKED), F.lit("812 nginx 10.0.0.1 80 10.0.0.2"), ms)
    lines = events(spark, sf).select(F.col("event_type").alias("run_id"), text.alias("value"))
    return mt.mean_per_second(lines, header_lines=0).select("run_id", epoch("time"), r6("RTT_ms_mean"))


def _run_logs(spark, sf):
    """All logs of a run, made of the events of a type; an hour stands for a second."""
    e = events(spark, sf)
    second, odd = F.date_format("hour", CLOCKED), F.lit("10.0.0.1:80 10.0.0.2:5000")
    num = lambda c: F.col(c).cast("string")
    even, third, fourth = (F.col("event_id") % n == 0 for n in (2, 3, 4))
    cat, lit = F.concat, F.lit
    snmp = F.concat_ws(" ", second, lit("SNMP Tcp: 1 200 120000 -1 50 60"), num("event_id"), lit("4 5"))
    netstat = F.concat_ws(" ", second, lit("NETSTAT TcpExt:" + " 0" * 20), F.col("event_id") * 2)
    rtt = F.concat_ws(" ", second, lit("812 nginx 10.0.0.1 80 10.0.0.2"), num("value"))
    disk = F.concat_ws(" ", lit("sda 1 1 1 1 1 1 1 1"), num("value"), lit("0"), num("user_id"), lit("0 0 0"))
    days = e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.min("hour").alias("hour"), F.min("ts").alias("ts"))
    label = F.when(F.dayofmonth("hour") % 3 == 0, ",ATTACK").otherwise(",NORMAL")
    lines = lambda file, values, header=CLOCKED: log_lines(e, file, values, header)
    micros = F.lpad((F.unix_micros("ts") - F.unix_micros("hour")).cast("string"), 10, "0")
    memory = e.select(
        F.col("event_type").alias("run_id"),
        cat(second, lit("."), micros).alias("timestamp"),
        F.col("user_id").alias("used_MB"),
        F.col("event_id").alias("available_MB"),
    )
    phases = days.select(
        F.col("event_type").alias("run_id"), F.lit("t").alias("file"), F.lit(0).alias("block"),
        F.unix_micros("ts").alias("line_no"), cat(second, label).alias("value"),
    )
    return {
        "packets": lines("p", [(cat(lit("@["), "user_id", lit("]: "), F.floor("value")), ALL)]),
        "retrans": lines("r", [(lit("@[nginx]: 1"), third)]),
        "mem_events": lines("m", [(cat(lit("@[nginx]: "), "user_id"), ALL)]),
        "throughput": lines("t", [(cat(lit("@tx_bytes: "), "event_id"), even), (cat(lit("@rx_bytes: "), "user_id"), ALL)]),
        "sockets": lines(
            "s",
            [(F.concat_ws(" ", lit("ESTAB"), num("user_id"), num("event_id"), odd), ALL), (cat(lit("x cwnd:"), "user_id", lit(" ssthresh:"), "event_id"), even)],
            RULED,
        ),
        "conn_fail": lines("c", [(snmp, ALL), (netstat, even)], "'# 'yyyy"),
        "softirqs": lines("q", [(cat(lit("NET_RX: 1 "), "event_id"), ALL), (cat(lit("NET_TX: 2 "), "event_id"), third)], RULED_FRACTION),
        "mem_usage": jobs.mem_usage(memory),
        "rtt": lines("l", [(lit("header"), "false"), (rtt, ALL)], "'TIME PID'"),
        "throttle": lines("n", [(cat(lit("nr_throttled "), F.col("event_id") % 3000), ALL)], RULED),
        "vmstat": lines("v", [(cat(lit("x,"), F.col("event_id") % 9, lit(",0")), ALL)], RULED),
        "iostat": lines("i", [(disk, fourth)], "'Device'"),
        "timeline": phases,
    }


def _feature_sql():
    grows = lambda c: f"coalesce(greatest({c} - lag({c} IGNORE NULLS) OVER w, 0), 0)"
    made = {
        "RTT_ms_mean": "rtt",
        "packet_loss_rate_pct": "CASE WHEN packets > 0 THEN retrans / packets * 100 ELSE 0 END",
        "retrans_segs_per_sec": "retrans",
        "conn_fail_rate_server": grows("last_id"),
        "listen_drops_per_sec": f"CASE WHEN drops IS NULL THEN 0 ELSE {grows('drops')} END",
        "Recv_Q_Bytes_max": "max_user",
        "Send_Q_Bytes_max": "last_id",
        "run_queue_len_cpu0": "coalesce(v.queue, 0)",
        "cwnd_min": "cwnd",
        "ssthresh_min": "ssthresh",
        "nic_usage_pct": "(coalesce(drops / 2, 0) + last_user) * 8 / 1e9 * 100",
        "total_packets_per_sec": "packets",
        "used_MB": "last_user",
        "available_MB": "last_id",
        "total_mem_events_per_sec": "users",
        "cpu_throttle_per_sec": grows("throttled"),
        "softirq_net_rx_per_sec": grows("last_id"),
        "softirq_net_tx_per_sec": grows("sent"),
        "iostat_r_await": "coalesce(d.value, 0)",
        "iostat_aqu_sz": "coalesce(d.user_id, 0)",
    }
    # Means of up to some hundred values with two decimals have no tie at eight.
    columns = ", ".join(f'round(CAST({made[f]} AS DOUBLE), 8) AS "{f}"' for f in FEATURES)
    return f"""WITH h AS (SELECT event_type AS run_id, date_trunc('hour', ts) AS time, avg(value) AS rtt,
    CAST(sum(floor(value)) AS DOUBLE) AS packets, count(*) FILTER (event_id % 3 = 0) AS retrans, max(event_id) AS last_id,
    max(user_id) AS max_user, coalesce(min(user_id) FILTER (event_id % 2 = 0), 0) AS cwnd,
    coalesce(min(event_id) FILTER (event_id % 2 = 0), 0) AS ssthresh, max(event_id * 2) FILTER (event_id % 2 = 0) AS drops,
    arg_max(user_id, ts) AS last_user, sum(user_id) AS users, arg_max(event_id % 3000, ts) AS throttled,
    coalesce(2 + max(event_id) FILTER (event_id % 3 = 0), 0) AS sent FROM events GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY time) AS nth FROM h),
  v AS (SELECT event_type, event_id % 9 AS queue, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS nth FROM events),
  d AS (SELECT event_type, value, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS nth FROM events WHERE event_id % 4 = 0),
  s AS (SELECT event_type, date_trunc('hour', min(ts)) AS start, CAST(day(min(ts)) % 3 = 0 AS BIGINT) AS label FROM events
    GROUP BY event_type, date_trunc('day', ts)),
  q AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY event_type ORDER BY start), date_trunc('day', start) + INTERVAL '23:59:59') AS stop FROM s)
SELECT n.run_id, CAST(epoch(n.time) AS BIGINT) AS time, {columns}, coalesce(q.label, 0) AS "Label" FROM n
  LEFT JOIN v ON v.event_type = n.run_id AND v.nth = n.nth LEFT JOIN d ON d.event_type = n.run_id AND d.nth = n.nth
  LEFT JOIN q ON q.event_type = n.run_id AND n.time >= q.start AND n.time < q.stop
  WINDOW w AS (PARTITION BY n.run_id ORDER BY n.time)"""


@query(_feature_sql())
def run_feature_table(spark, sf):
    out = jobs.feature_table(_run_logs(spark, sf), header_lines=0)
    return bigs(out.select("run_id", epoch("time"), *[F.round(c, 8).alias(c) for c in FEATURES], "Label"))


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(event_type, ts) AS event_type,
  arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1, 2""")
def last_per_key(spark, sf):
    rows = events(spark, sf).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_type", "value", "event_id")
    return al.last_per_key(rows, ["user_id", "day"], "ts").drop("ts")


@query("""SELECT CAST(user_id AS VARCHAR) AS host, """ + ", ".join(
    f"coalesce(arg_max(event_id, ts) FILTER (event_type = '{t}'), 0) AS {t}" for t in EVENT_TYPES
) + " FROM events GROUP BY 1")
def merge_counters(spark, sf):
    rows = events(spark, sf).select(F.col("user_id").cast("string").alias("host"), "event_type", "ts", "event_id")
    return al.merge_counters(rows, "host", "event_type", "ts", "event_id", EVENT_TYPES)


# ---- alignment -------------------------------------------------------------------


@query("""SELECT strftime(ts, '%Y-%m-%d') AS run_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time, """ + ", ".join(
    f"count(*) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES
) + " FROM events GROUP BY 1, 2")
def align_outer(spark, sf):
    day = F.date_format("hour", "yyyy-MM-dd").alias("run_id")
    series = {
        t: events(spark, sf).where(F.col("event_type") == t).groupBy(day, F.col("hour").alias("time")).agg(
            F.count(F.lit(1)).alias(t)
        )
        for t in EVENT_TYPES
    }
    return al.align(series, ["run_id", "time"]).withColumn("time", F.unix_seconds("time"))


HALVES = """h AS (SELECT event_type AS run_id, date_trunc('hour', ts) AS time, event_id % 2 AS odd, count(*) AS n, max(value) AS peak
    FROM events GROUP BY ALL)"""


def halves(spark, sf):
    """Per type and hour, the events of even and of odd number as two series."""
    rows = events(spark, sf).groupBy(F.col("event_type").alias("run_id"), F.col("hour").alias("time"), (F.col("event_id") % 2).alias("odd"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))


@query(f"""WITH {HALVES}, p AS (SELECT * FROM h WHERE odd = 0), r AS (SELECT * FROM h WHERE odd = 1)
SELECT p.run_id, CAST(epoch(p.time) AS BIGINT) AS time, p.n AS total_packets_per_sec,
  round(coalesce(r.n, 0) / p.n * 100, 6) AS packet_loss_rate_pct, coalesce(r.n, 0) AS retrans_segs_per_sec
FROM p LEFT JOIN r ON p.time = r.time AND p.run_id = r.run_id""")
def loss_left_join(spark, sf):
    h = halves(spark, sf)
    packets = h.where("odd = 0").select("run_id", "time", F.col("n").alias("total_packets_per_sec"))
    retrans = h.where("odd = 1").select("run_id", "time", F.col("n").alias("retrans_count"))
    out = mt.loss_rate(packets, retrans)
    return out.withColumns({"time": F.unix_seconds("time"), "packet_loss_rate_pct": F.round("packet_loss_rate_pct", 6)})


@query(f"""WITH {HALVES}, b AS (SELECT run_id, time, n, row_number() OVER (PARTITION BY run_id ORDER BY time) AS i FROM h WHERE odd = 0),
  s AS (SELECT run_id, peak, row_number() OVER (PARTITION BY run_id ORDER BY time) AS i FROM h WHERE odd = 1)
SELECT b.run_id, CAST(epoch(b.time) AS BIGINT) AS time, b.n, coalesce(s.peak, 0) AS sample
FROM b LEFT JOIN s ON b.run_id = s.run_id AND b.i = s.i""")
def zip_positional(spark, sf):
    h = halves(spark, sf)
    base = h.where("odd = 0").select("run_id", "time", "n")
    samples = h.where("odd = 1").select("run_id", F.col("time").alias("at"), F.col("peak").alias("sample"))
    return al.zip_positional(base, samples, series_order="at").withColumn("time", F.unix_seconds("time"))


@query("""WITH p AS (SELECT event_type, date_trunc('hour', ts + INTERVAL 1 HOUR) AS due, max(ts) AS made, arg_max(value, ts) AS prediction
    FROM events GROUP BY ALL),
  s AS (SELECT event_type, date_trunc('hour', ts) AS due, arg_max(value, ts) AS actual FROM events GROUP BY ALL)
SELECT p.event_type, epoch_us(p.made) AS made_at, CAST(epoch(p.due) AS BIGINT) AS time, prediction, actual
FROM p JOIN s ON p.event_type = s.event_type AND p.due = s.due""")
def forecast_align_seconds(spark, sf):
    # An hour stands for a second.
    rows = events(spark, sf).select("event_type", F.col("ts").alias("time"), F.col("value").alias("prediction"), F.col("value").alias("actual"))
    out = al.align_forecast(rows.drop("actual"), rows.drop("prediction"), "1 hour", "event_type", unit="hour")
    return out.withColumns({"made_at": F.unix_micros("made_at"), "time": F.unix_seconds("time")})


@query("""WITH p AS (SELECT event_type, date_trunc('hour', min(ts)) AS start, max(CAST(day(ts) % 3 = 0 AS INT)) AS label
    FROM events GROUP BY event_type, date_trunc('day', ts)),
  q AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY event_type ORDER BY start),
    date_trunc('day', start) + INTERVAL '23:59:59') AS stop FROM p)
SELECT e.event_type AS run_id, e.event_id, CAST(coalesce(q.label, 0) AS BIGINT) AS "Label"
FROM events e LEFT JOIN q ON e.event_type = q.event_type AND e.ts >= q.start AND e.ts < q.stop""")
def label_phases(spark, sf):
    rows = events(spark, sf).withColumnRenamed("event_type", "run_id")
    phases = rows.groupBy("run_id", F.date_trunc("day", "ts").alias("day")).agg(
        F.date_trunc("hour", F.min("ts")).alias("start"), F.max((F.dayofmonth("ts") % 3 == 0).cast("int")).alias("label")
    )
    return bigs(al.label_phases(rows.select("run_id", "event_id", "ts"), phases, time="ts").drop("ts"))


@query(f"""WITH h AS ({HOURLY})
SELECT p.run_id AS host, CAST(epoch(p.time) AS BIGINT) AS made_at, CAST(epoch(a.time) AS BIGINT) AS time,
  p.peak AS prediction, a.n AS actual FROM h p JOIN h a ON p.run_id = a.run_id AND a.time = p.time + INTERVAL 10 HOUR""")
def forecast_align(spark, sf):
    h = hourly(spark, sf).withColumnRenamed("run_id", "host")
    out = al.align_forecast(
        h.withColumnRenamed("peak", "prediction"), h.withColumnRenamed("n", "actual"), horizon="10 hours"
    )
    return out.withColumns({"made_at": F.unix_seconds("made_at"), "time": F.unix_seconds("time")})


# ---- windows ---------------------------------------------------------------------


@query("""WITH c AS (SELECT event_type AS run_id, event_id, ts,
    (row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1) % 1000 * 3 + event_id % 3 AS c FROM events)
SELECT run_id, event_id, c, coalesce(greatest(c - lag(c) OVER (PARTITION BY run_id ORDER BY ts), 0), 0) AS c_per_sec FROM c""")
def counter_rate(spark, sf):
    rows = sr.with_position(events(spark, sf).withColumnRenamed("event_type", "run_id"), "run_id", "ts", span=SPAN)
    counter = F.col("pos") % 1000 * 3 + F.col("event_id") % 3
    rows = rows.select("run_id", "event_id", "pos", counter.alias("c"))
    return sr.counter_delta(rows, "c", "run_id", "pos", pos="pos").drop("pos")


def _rates_sql():
    source = [f"event_id * {i + 1} AS {c}" for i, c in enumerate(COUNTERS) if c != "ebpf_retrans_count"]
    grown = [
        f"greatest({c} - lag({c}) OVER w, 0) AS d_{c}" for c in COUNTERS
    ]
    per = lambda c: f"coalesce(d_{c} / dt, 0)"
    share = lambda n, d, by: f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} * {by} ELSE 0 END"
    made = {
        "RTT_ms_mean": share("value", "(event_id % 3)", 1),
        "packet_loss_rate_pct": share("d_ebpf_retrans_count", "d_ebpf_tx_attempts", 100),
        "retrans_segs_per_sec": per("ebpf_retrans_count"),
        "conn_fail_rate_server": share("d_snmp_ListenDrops", "(d_snmp_ListenDrops + d_snmp_PassiveOpens)", 100),
        "listen_drops_per_sec": per("snmp_ListenDrops"),
        "Recv_Q_Bytes_max": "event_id % 100",
        "Send_Q_Bytes_max": "event_id % 50",
        "run_queue_len_cpu0": "value / 10",
        "cwnd_min": "event_id % 10",
        "ssthresh_min": "event_id % 7",
        "nic_usage_pct": "coalesce((d_nic_rx_bytes + d_nic_tx_bytes) * 8 / (1e9 * dt) * 100, 0)",
        "total_packets_per_sec": per("ebpf_packet_count"),
        "used_MB": "16000.0 - (value + 8000)",
        "available_MB": "value + 8000",
        "total_mem_events_per_sec": per("ebpf_mem_events"),
        "cpu_throttle_per_sec": per("cpu_nr_throttled"),
        "softirq_net_rx_per_sec": per("softirq_net_rx"),
        "softirq_net_tx_per_sec": per("softirq_net_tx"),
        "iostat_r_await": share("d_disk_read_time_ms", "d_disk_read_ios", 1),
        "iostat_aqu_sz": "coalesce(d_disk_io_weighted_ms / (dt * 1000), 0)",
    }
    columns = ", ".join(f'round(CAST({made[f]} AS DOUBLE), 6) AS "{f}"' for f in FEATURES)
    return f"""WITH s AS (SELECT *, event_id % 5000 AS ebpf_retrans_count, {", ".join(source)} FROM events),
  d AS (SELECT *, {", ".join(grown)}, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt FROM s
    WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT CAST(user_id AS VARCHAR) AS host, epoch_us(ts) AS time, {columns} FROM d"""


def _rounded_rates(df):
    return df.select("host", F.unix_micros("time").alias("time"), *[r6(c) for c in FEATURES])


@query(_rates_sql())
def elapsed_rate(spark, sf):
    return _rounded_rates(snapshot_rates(as_snapshots(events(spark, sf)), span=SPAN))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6)
  AS value FROM events""")
def trailing_mean(spark, sf):
    rows = events(spark, sf).select("event_id", "event_type", "ts", "value")
    return sr.rolling_mean(rows, "value", "event_type", "ts", back=3, span=SPAN).select("event_id", r6("value"))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6)
  AS value FROM events""")
def centered_mean(spark, sf):
    rows = events(spark, sf).select("event_id", "event_type", "ts", "value")
    return sr.rolling_mean(rows, "value", "event_type", "ts", back=1, ahead=1, span=SPAN).select("event_id", r6("value"))


@query(f"""WITH h AS ({HOURLY})
SELECT run_id, {SECONDS}, round(CASE WHEN count(mean) OVER w = 10 THEN max(mean) OVER w END, 6) AS y_target
FROM h WINDOW w AS (PARTITION BY run_id ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)""")
def future_max(spark, sf):
    rows = hourly(spark, sf).select("run_id", "time", "mean")
    return sr.future_max(rows, "mean", "run_id", "time").select("run_id", epoch("time"), r6("y_target"))


_STEPS = 6


def _steps_sql(padded):
    picks = []
    for s in range(_STEPS):
        for j, t in enumerate(EVENT_TYPES):
            lag = f"lag({t}, {_STEPS - 1 - s}) OVER w" if s < _STEPS - 1 else t
            if padded:
                lag = f"coalesce({lag}, first_value({t}) OVER w)"
            picks.append(f"CAST({lag} AS DOUBLE) AS f{s * len(EVENT_TYPES) + j}")
    return f"""WITH h AS ({BY_TYPE}), s AS (SELECT run_id, time, row_number() OVER w AS i,
  lead(time) OVER w AS following, {", ".join(picks)} FROM h WINDOW w AS (PARTITION BY run_id ORDER BY time))"""


_F = [f"f{i}" for i in range(_STEPS * len(EVENT_TYPES))]


def _flat(df, *keep):
    return df.select(*keep, *[F.get("features", i).alias(c) for i, c in enumerate(_F)])


@query(f"""{_steps_sql(False)} SELECT run_id, {SECONDS}, {", ".join(_F)} FROM s WHERE i >= {_STEPS} AND following IS NOT NULL""")
def sequence_windows(spark, sf):
    usable = ds.long_enough(hourly_by_type(spark, sf), "run_id", _STEPS + 1)
    return _flat(sr.sequences(usable, EVENT_TYPES, "run_id", "time", _STEPS), "run_id", epoch("time"))


@query(f"""{_steps_sql(False)} SELECT run_id, {SECONDS}, {", ".join(_F)} FROM s WHERE i >= {_STEPS} AND following IS NOT NULL""")
def chunked_windows(spark, sf):
    """Windows made of a stored table of chunks, which holds each row about once."""
    rows = sr.with_position(hourly_by_type(spark, sf), "run_id", "time", size="_size")
    ends = F.col("pos").between(_STEPS - 1, F.col("_size") - 2)
    chunks = settle(sr.sequence_chunks(rows, EVENT_TYPES, "run_id", _STEPS, ["time"], ends, rows=50), "chunks")
    return _flat(sr.chunk_windows(chunks, "run_id", _STEPS), "run_id", epoch("time"))


@query(f"""{_steps_sql(True)} SELECT run_id, {SECONDS}, {", ".join(_F)} FROM s""")
def padded_buffer(spark, sf):
    return _flat(sr.sequences(hourly_by_type(spark, sf), EVENT_TYPES, "run_id", "time", _STEPS, pad=True), "run_id", epoch("time"))


@query(f"""{_steps_sql(False)}, p AS (SELECT run_id, time, row_number() OVER (ORDER BY run_id, time) - 1 AS pos,
    count(*) OVER () AS total FROM s WHERE i >= {_STEPS} AND following IS NOT NULL),
  c AS (SELECT *, CAST(floor(total * 0.8) AS BIGINT) AS cut FROM p)
SELECT run_id, {SECONDS}, pos, CASE WHEN pos < cut THEN 'train' ELSE 'test' END AS split,
  CASE WHEN pos >= cut THEN NULL WHEN pos < (cut % 3) * (cut // 3 + 1) THEN pos // (cut // 3 + 1)
    ELSE cut % 3 + (pos - (cut % 3) * (cut // 3 + 1)) // (cut // 3) END AS fold FROM c""")
def position_split(spark, sf):
    windows = sr.sequences(hourly_by_type(spark, sf), EVENT_TYPES, "run_id", "time", _STEPS).select("run_id", "time")
    return bigs(ds.position_split(windows, "run_id", "time").withColumn("time", F.unix_seconds("time")))


# ---- resampling and scaling ------------------------------------------------------

_GRID = """g AS (SELECT run_id, size, unnest(range(size * 10)) AS k FROM (SELECT run_id, count(*) AS size FROM s GROUP BY 1)),
  p AS (SELECT *, k * (size - 1) // (size * 10 - 1) AS i, k * (size - 1) / (size * 10 - 1) AS place FROM g)"""


def _between(c):
    return f"a.{c} + (coalesce(b.{c}, a.{c}) - a.{c}) * (p.place - p.i)"


_AROUND = """FROM p JOIN s a ON a.run_id = p.run_id AND a.i = p.i LEFT JOIN s b ON b.run_id = p.run_id AND b.i = p.i + 1
  JOIN s t ON t.run_id = p.run_id AND t.i = CAST(round_even(p.place, 0) AS BIGINT)"""


@query(f"""WITH h AS ({HOURLY}), s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY time) - 1 AS i FROM h), {_GRID}
SELECT p.run_id, p.k, round({_between('n')}, 6) AS n, round({_between('peak')}, 6) AS peak,
  strftime(t.time, '%Y-%m-%d %H:%M:%S') AS time {_AROUND}""")
def upsample_linear(spark, sf):
    rows = hourly(spark, sf).withColumn("clock", F.date_format("time", CLOCKED))
    out = au.upsample(rows, ["n", "peak"], "clock", "run_id", "time")
    return out.select("run_id", "k", r6("n"), r6("peak"), F.col("clock").alias("time"))


@query(f"""WITH h AS ({HOURLY}), s AS (SELECT run_id, time, row_number() OVER w - 1 AS i,
    avg(n) OVER m AS n, avg(peak) OVER m AS peak, avg(n % 2) OVER m AS "Label" FROM h
    WINDOW w AS (PARTITION BY run_id ORDER BY time), m AS (PARTITION BY run_id ORDER BY time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
  {_GRID}, u AS (SELECT p.run_id, p.k, {_between('n')} AS n, {_between('peak')} AS peak, {_between('"Label"')} AS "Label",
    strftime(t.time, '%Y-%m-%d %H:%M:%S') AS time {_AROUND})
SELECT run_id, v AS variation, k, round(greatest(avg(n) OVER c, 0), 6) AS n, round(greatest(avg(peak) OVER c, 0), 6) AS peak,
  round_even("Label", 0) AS "Label", time FROM u, (SELECT unnest([1, 2]) AS v)
  WINDOW c AS (PARTITION BY run_id, v ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def augment_noise_free(spark, sf):
    return _augmented(spark, sf, 0.0)


@query()
def augment_noise(spark, sf):
    return _augmented(spark, sf, 0.02)


def _augmented(spark, sf, level):
    rows = hourly(spark, sf).select(
        "run_id", "time", "n", "peak", (F.col("n") % 2).alias("Label"), F.date_format("time", CLOCKED).alias("clock")
    )
    out = au.augment_series(rows, ["n", "peak", "Label"], "clock", "run_id", "time", level=level, variations=2)
    return out.select("run_id", "variation", "k", r6("n"), r6("peak"), "Label", F.col("clock").alias("time"))


_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "constant"]


@query("""WITH l AS (SELECT *, 7.0::DOUBLE AS constant FROM lineitem),
  m AS (SELECT """ + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _SCALED) + """ FROM l)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, """ + ", ".join(
    f"round(({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END, 6) AS {c}" for c in _SCALED
) + " FROM l, m")
def minmax_fit_apply(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SCALED[:3], F.lit(7.0).alias("constant"))
    scaled = ds.scale(rows, ds.fit_minmax(rows, _SCALED), _SCALED)
    return bigs(scaled.select("l_orderkey", "l_linenumber", *[r6(c) for c in _SCALED]))


@query("""SELECT event_id, round(value, 6) AS value FROM events""")
def minmax_inverse(spark, sf):
    rows = events(spark, sf).select("event_id", "value")
    mm = ds.fit_minmax(rows, "value")
    return ds.unscale(ds.scale(rows, mm, "value"), mm, "value", "value").select("event_id", r6("value"))


# ---- evaluation ------------------------------------------------------------------


def _forecasts(spark, sf):
    rows = events(spark, sf).select("event_type", "ts", "value")
    columns = {
        "lag1": lambda w: F.lag("value", 1).over(w),
        "mean4": lambda w: F.avg("value").over(w.rowsBetween(-4, -1)) - 5,
    }
    made = sr.over_series(rows, "event_type", "ts", columns, back=4, span=SPAN)
    return sc.evaluation_rows(made.where(F.col("lag1").isNotNull()), "value", ["lag1", "mean4"])


def _measures_sql(p):
    return f"""SELECT '{p}' AS model, round(avg(abs(y - {p})), 4) AS mae, round(sqrt(avg((y - {p}) ** 2)), 4) AS rmse,
  round(avg(abs((y - {p}) / (y + 1e-10))) * 100, 2) AS mape,
  round(1 - sum((y - {p}) ** 2) / (count(*) * var_pop(y)), 4) AS r2 FROM f"""


_METRICS = f"""WITH r AS (SELECT value AS y, lag(value) OVER w AS lag1,
    avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) - 5 AS mean4
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
  f AS (SELECT y, greatest(lag1, 0) AS lag1, greatest(mean4, 0) AS mean4 FROM r WHERE lag1 IS NOT NULL AND y > 0),
  m AS ({_measures_sql('lag1')} UNION ALL {_measures_sql('mean4')})"""


@query(f"{_METRICS} SELECT * FROM m")
def metrics_table(spark, sf):
    return sc.regression_metrics(_forecasts(spark, sf), "value", ["lag1", "mean4"])


@query(f"{_METRICS} SELECT arg_max(model, r2) AS model, max(r2) AS r2 FROM m")
def best_model(spark, sf):
    return sc.best_model(sc.regression_metrics(_forecasts(spark, sf), "value", ["lag1", "mean4"]))


@query(f"""{_METRICS}, g AS (SELECT max(rmse) FILTER (model = 'lag1') AS x, max(rmse) FILTER (model = 'mean4') AS y FROM m)
SELECT CASE WHEN x < y THEN 'lag1' ELSE 'mean4' END AS better, round(abs(x - y), 2) AS gap FROM g""")
def rmse_gap(spark, sf):
    return sc.rmse_gap(sc.regression_metrics(_forecasts(spark, sf), "value", ["lag1", "mean4"]), "lag1", "mean4")


@query("""SELECT list_extract([""" + ", ".join(f"'{f}'" for f in FEATURES) + """], l_partkey % 1200 % 20 + 1) AS feature,
  sum(l_quantity) AS importance FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 5""")
def importance_fold(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 1200).alias("pos"), F.col("l_quantity").alias("importance"))
    return sc.fold_importance(rows, FEATURES, top=5)


@query("""SELECT event_type, event_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS pos
  FROM events) WHERE pos % 50 = 0""")
def stride_rows(spark, sf):
    return sc.stride(events(spark, sf).select("event_type", "event_id", "ts"), "event_type", "ts", span=SPAN).drop("ts")


@query("""SELECT event_type, event_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS pos
  FROM events) WHERE pos >= 100 AND pos < 400""")
def zoom_rows(spark, sf):
    return sc.zoom(events(spark, sf).select("event_type", "event_id", "ts"), "event_type", "ts", span=SPAN).drop("ts")


# ---- load plans ------------------------------------------------------------------

_TARGETS = f"""SELECT *, max(traffic) OVER (PARTITION BY day) AS peak,
  greatest(5, traffic * 100 // max(traffic) OVER (PARTITION BY day)) AS connections FROM ({PROFILE})"""


@query(_TARGETS)
def load_targets(spark, sf):
    return ld.load_targets(profile(spark, sf))


@query(f"""SELECT day, hour, traffic, CASE WHEN hour < 12 THEN 'normal' ELSE 'stress' END AS phase,
  CASE WHEN hour < 12 THEN connections WHEN day = '2024-01-03' THEN
    CASE WHEN hour < 16 THEN 500 WHEN hour < 21 THEN 1000 ELSE 700 END
  WHEN hour < 16 THEN 500 WHEN hour < 20 THEN 700 ELSE 1000 END AS connections FROM ({_TARGETS})""")
def load_stress(spark, sf):
    return ld.stress_ladder(profile(spark, sf), day_ladders={"2024-01-03": ld.DAY_LADDERS["0803"]})


_WEIGHTS = """w AS (SELECT day, name, weight, row_number() OVER (PARTITION BY day ORDER BY weight DESC, name DESC) AS place
    FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, 'u' || user_id AS name, count(*) AS weight FROM events GROUP BY 1, 2)),
  m AS (SELECT day, name, weight, place FROM w WHERE place <= 6 UNION ALL
    SELECT day, 'other', CAST(sum(weight) AS BIGINT), 7 FROM w WHERE place > 6 GROUP BY 1)"""


def _named(spark, sf):
    return events(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("u"), "user_id").alias("name"), "event_id", "event_type"
    )


@query(f"WITH {_WEIGHTS} SELECT * FROM m")
def traffic_mix(spark, sf):
    return bigs(ld.category_weights(_named(spark, sf), "name", 6, by="day"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day,
  round(avg(CASE WHEN event_type IN ('error', 'signup') THEN 100 ELSE 0 END), 6) AS close_pct FROM events GROUP BY 1""")
def closed_share(spark, sf):
    return ld.closed_share(_named(spark, sf), "event_type", ["error", "signup"], by="day").select("day", r6("close_pct"))


@query(f"""WITH {_WEIGHTS}, h AS (SELECT *, sum(weight) OVER (PARTITION BY day ORDER BY place) AS hi FROM m),
  d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, event_id % 400 + 1 AS draw FROM events)
SELECT d.day, d.event_id, d.draw, coalesce(arg_min(h.name, h.place), 'none') AS host
FROM d LEFT JOIN h ON d.day = h.day AND h.hi >= d.draw GROUP BY 1, 2, 3""")
def weighted_pick(spark, sf):
    rows = _named(spark, sf)
    draws = rows.select("day", "event_id", (F.col("event_id") % 400 + 1).alias("draw"))
    return ld.weighted_pick(draws, ld.category_weights(rows, "name", 6, by="day"), "draw", "none", "day", name="host")


@query()
def request_mix(spark, sf):
    rows = _named(spark, sf)
    weights = ld.category_weights(rows, "name", 6, by="day")
    return ld.request_mix(rows.select("day", "event_id"), weights, "day", "event_id", "none", ld.CLOSE_PCT["0801"])


# ---- views -----------------------------------------------------------------------

# Ranks count from 1 here: the SQL engine at hand returns wrong rows when a
# `row_number() - 1` is filtered above a UNION ALL.
_RANKED = """r AS (SELECT event_type, event_id, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS nth
  FROM events), l AS (SELECT event_type, nth, 'value' AS metric, value FROM r UNION ALL
  SELECT event_type, nth, 'user_id', CAST(user_id AS DOUBLE) FROM r)"""


def _history_sql(n):
    picks = ", ".join(f"max(value) FILTER (nth = {i + 1}) AS ago_{i}" for i in range(n - 1, -1, -1))
    return f"WITH {_RANKED} SELECT event_type, metric, {picks} FROM l WHERE nth <= {n} GROUP BY 1, 2"


@query(_history_sql(4))
def recent_values(spark, sf):
    return vw.recent_values(events(spark, sf), ["value", "user_id"], "event_type", "ts")


@query(_history_sql(30))
def history_pivot(spark, sf):
    return vw.history_pivot(events(spark, sf), ["value", "user_id"], "event_type", "ts")


@query(f"WITH {_RANKED} SELECT event_type, event_id, user_id, value, nth - 1 AS ago FROM r WHERE nth <= 5")
def last5(spark, sf):
    rows = events(spark, sf).select("event_type", "event_id", "user_id", "value", "ts")
    return bigs(vw.latest(rows, "event_type", "ts").drop("ts"))


@query(f"WITH {_RANKED} SELECT event_type, event_id, value, nth - 1 AS ago FROM r WHERE nth <= 991")
def chart_history(spark, sf):
    rows = events(spark, sf).select("event_type", "event_id", "value", "ts")
    return bigs(vw.chart_history(rows, "event_type", "ts").drop("ts"))


@query("""WITH r AS (SELECT event_type, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS nth FROM events),
  p AS (SELECT event_type, nth - 1 AS ago, value AS actual, CAST(NULL AS DOUBLE) AS forecast FROM r WHERE nth <= 991
    UNION ALL SELECT event_type, nth - 11, NULL, CAST(event_id % 1000 AS DOUBLE) FROM r WHERE nth <= 1001)
SELECT event_type, ago, max(actual) AS actual, max(forecast) AS forecast FROM p GROUP BY 1, 2""")
def chart_points(spark, sf):
    rows = events(spark, sf).withColumn("guess", F.col("event_id") % 1000)
    return bigs(vw.chart_points(rows, "event_type", "ts", "value", "guess"))


@query("""SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1""")
def latest_row(spark, sf):
    return vw.latest_row(events(spark, sf).select("user_id", "event_id", "value", "ts"), "user_id", "ts").drop("ts")


@query(f"""WITH h AS ({HOURLY}) SELECT run_id AS host, {SECONDS}, peak AS prediction FROM h
WHERE peak > (SELECT 3 * avg(value) FROM events)""")
def threshold_alerts(spark, sf):
    predictions = hourly(spark, sf).select(F.col("run_id").alias("host"), epoch("time"), F.col("peak").alias("prediction"))
    return vw.alerts(predictions, events(spark, sf).agg((F.avg("value") * 3).alias("threshold")))


# ---- snapshots from text -----------------------------------------------------------


def _host_texts(spark, sf):
    """One snapshot per order: its line items are the sockets, its numbers the counters."""
    items = table(spark, sf, "lineitem")
    socket = F.format_string(
        "%s %d %d 10.0.0.1:80 10.0.0.2:%d\n\t cubic rtt:%d.5/0.7 cwnd:%d ssthresh:%d",
        F.when(F.col("l_returnflag") == "N", "SYN-SENT").otherwise("ESTAB"), F.col("l_suppkey"), F.col("l_partkey"),
        F.col("l_linenumber"), F.col("l_linenumber"), F.col("l_suppkey") + 1, F.col("l_partkey") + 2,
    )
    lists = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(socket), "\n").alias("s"))
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").join(lists, "o_orderkey", "left").select(
        "o_orderkey",
        F.concat(F.lit("State Recv-Q Send-Q Local Peer\n"), F.coalesce("s", F.lit(""))).alias("sockets"),
        F.format_string("Tcp: a b c d e f g h i j k l m\nTcp: 1 2 3 4 %d %d %d 8 9 10 11 %d 13", k, k + 1, k + 2, k + 3).alias("snmp"),
        F.when(k % 3 > 0, F.format_string("TcpExt: 1 %s %d 7", F.repeat(F.lit("0 "), 19), k * 2)).alias("netstat"),
        F.format_string("  CPU0 CPU1\n NET_TX: %d 1\n NET_RX: %d 2 x3", k, k * 5).alias("softirqs"),
    )


@query("""WITH s AS (SELECT l_orderkey AS o_orderkey, sum(l_linenumber + 0.5) AS rtt, count(*) AS n, min(l_suppkey) + 1 AS cwnd, min(l_partkey) + 2 AS ssthresh,
    max(CASE WHEN l_returnflag <> 'N' THEN l_suppkey END) AS recv, max(CASE WHEN l_returnflag <> 'N' THEN l_partkey END) AS send
    FROM lineitem GROUP BY ALL)
SELECT o_orderkey, coalesce(rtt, 0.0)::DOUBLE AS tcp_rtt_sum, coalesce(n, 0) AS tcp_rtt_count, coalesce(recv, 0) AS tcp_recv_q_max,
  coalesce(send, 0) AS tcp_send_q_max, coalesce(cwnd, 0) AS tcp_cwnd_min, coalesce(ssthresh, 0) AS tcp_ssthresh_min,
  o_orderkey AS snmp_ActiveOpens, o_orderkey + 1 AS snmp_PassiveOpens, o_orderkey + 2 AS snmp_AttemptFails, o_orderkey + 3 AS snmp_RetransSegs,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 2 ELSE 0 END AS snmp_ListenDrops, o_orderkey * 5 + 2 AS softirq_net_rx, o_orderkey + 1 AS softirq_net_tx
FROM orders LEFT JOIN s USING (o_orderkey)""")
def snapshot_text(spark, sf):
    return sn.text_values(_host_texts(spark, sf))


@query("""SELECT l_orderkey AS o_orderkey, count(*) AS sockets, sum(l_suppkey)::BIGINT AS recv_q, sum(l_partkey)::BIGINT AS send_q
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N' GROUP BY ALL""")
def socket_states(spark, sf):
    rows = sn.socket_rows(_host_texts(spark, sf).select("o_orderkey", "sockets"))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("sockets"), F.sum("recv_q").alias("recv_q"), F.sum("send_q").alias("send_q"))


# ---- models ----------------------------------------------------------------------


def _windows(spark, sf):
    rows = hourly_by_type(spark, sf)
    return _stored(spark, *jobs.training_set(rows, cols=EVENT_TYPES, target="click", steps=_STEPS, horizon=4))


def _stored(spark, data, mm):
    """A fit reads its rows many times, so the set is written first."""
    path = scratch_path(spark, "dataset")
    write_dataset(data, mm, path)
    return read_dataset(spark, path)


@query()
def training_windows(spark, sf):
    data, _ = _windows(spark, sf)
    return data.select("run_id", epoch("time"), "features", "y_target", "pos", "split", "fold")


@query()
def gbt_scores(spark, sf):
    data, mm = _windows(spark, sf)
    model = md.fit_gbt(data.where("split = 'train'"), maxIter=5, maxDepth=3)
    return md.score(data.where("split = 'test'"), model, mm).select("run_id", epoch("time"), "pos", "prediction")


@query()
def gbt_grid(spark, sf):
    data, _ = _windows(spark, sf)
    tuned = jobs.train(data, {"maxIter": [2, 4], "maxDepth": [2, 3]}, parallelism=2)
    return md.grid_table(spark, tuned)


@query()
def model_comparison(spark, sf):
    data, mm = _windows(spark, sf)
    models = {"gbt": md.gbt(maxIter=5, maxDepth=3), **md.baselines()}
    return jobs.evaluate(data, models, mm)["metrics"]


@query()
def gbt_importance(spark, sf):
    data, _ = _windows(spark, sf)
    model = md.fit_gbt(data.where("split = 'train'"), maxIter=5, maxDepth=3)
    return jobs.importance(spark, model, EVENT_TYPES)


# ---- streams ---------------------------------------------------------------------


#: Files that a stream of events is read from, one in each micro-batch.
SLICES, FEW_SLICES = 10, 8
#: The host that closes a stream: its file comes so late that all others are silent.
END_HOST = -1
HOUR_US = 3_600_000_000


def _moved(shift: str, slices: int) -> str:
    """The slice of each event by its time and a shift in seconds, for either side."""
    return f"floor((sec + {shift} - lo) * {slices} / (hi - lo + 1))"


def _slices_sql(shift: str, slices: int) -> str:
    return f"""t AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS sec FROM events),
  e AS (SELECT t.*, CAST({_moved(shift, slices)} AS BIGINT) AS slice FROM t, (SELECT min(sec + {shift}) AS lo, max(sec + {shift}) AS hi FROM t))"""


def _event_stream(spark, sf, shift: str = "0", slices: int = FEW_SLICES):
    """Snapshots of the events from files by time, each event in the file of its time
    plus a shift; a minute lies between the files, two days before the one that ends
    the stream."""
    rows = events(spark, sf).drop("hour").withColumn("sec", F.unix_seconds("ts"))
    ends = rows.agg(F.min(F.expr(f"sec + {shift}")).alias("lo"), F.max(F.expr(f"sec + {shift}")).alias("hi"))
    end = rows.limit(1).withColumns({"user_id": F.lit(END_HOST).cast("bigint"), "slice": F.lit(slices).cast("bigint")})
    cut = rows.join(ends).withColumn("slice", F.expr(_moved(shift, slices)).cast("bigint")).drop("lo", "hi")
    folder = scratch_path(spark, "event-slices")
    cut.unionByName(end).drop("sec").repartition("slice").write.partitionBy("slice").parquet(folder)
    order_files(spark, folder, lambda name: 60 * int(name.split("=")[1]) + (2 * 86400 if name.endswith(f"={slices}") else 0))
    files = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return as_snapshots(files.select("*", live.arrived()), "arrived")


def _run(spark, stream, name):
    out = scratch_path(spark, name)
    live.start_predictions(stream, out, f"{out}-state", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).where(F.col("host") != str(END_HOST))


# Events come up to an hour late, and those by an hour are still in order.
@query(_rates_sql())
def stream_rates(spark, sf):
    shuffled = _event_stream(spark, sf, "event_id % 7 * 600", SLICES)
    features = live.stream_features(shuffled, steps=2, late="1 hour", silent="1 day")
    return _rounded_rates(_run(spark, features.drop("features", "dropped"), "rates"))


#: Some events come five days too late, more than rows wait for.
LATE_SHIFT = "CASE WHEN event_id % 97 = 0 THEN 432000 ELSE event_id % 7 * 600 END"
_LATE_SQL = f"""WITH {_slices_sql(LATE_SHIFT, FEW_SLICES)},
  b AS (SELECT *, max(us) OVER (PARTITION BY user_id ORDER BY slice RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {HOUR_US} AS upto FROM e),
  o AS (SELECT r.event_id, max(s.us) AS gone FROM b r JOIN e s ON s.user_id = r.user_id AND s.slice < r.slice AND s.us <= r.upto GROUP BY 1),
  late AS (SELECT b.* FROM b JOIN o USING (event_id) WHERE us < gone),
  seen AS (SELECT * FROM e WHERE event_id NOT IN (SELECT event_id FROM late))"""


def _late_tables(spark, sf, limit):
    """Predictions, alerts and late rows of the events, written as by the live job; the
    last round trip stands for the prediction."""

    def split(rows):
        made = rows.where("late IS NULL").select("host", "time", F.col("RTT_ms_mean").alias("prediction"))
        made = made.where(F.col("host") != str(END_HOST))
        return {"predictions": made, "alerts": vw.alerts(made, limit), "late": rows.where("late IS NOT NULL").select("late.*")}

    features = live.stream_features(_event_stream(spark, sf, LATE_SHIFT), steps=2, late="1 hour", silent="1 day", keep_late=True)
    out = scratch_path(spark, "live-tables")
    live.start_tables(features, split, out, f"{out}-state", available_now=True).awaitTermination()
    return out


@query(f"""{_LATE_SQL} SELECT CAST(user_id AS VARCHAR) AS host, us AS time, event_id AS snmp_ActiveOpens, value AS tcp_rtt_sum FROM late""")
def stream_late(spark, sf):
    rows = spark.read.parquet(f"{_late_tables(spark, sf, 30.0)}/late")
    return rows.select("host", F.unix_micros("timestamp").alias("time"), "snmp_ActiveOpens", "tcp_rtt_sum")


@query(f"""{_LATE_SQL} SELECT CAST(user_id AS VARCHAR) AS host, us AS time, round(value / (event_id % 3), 6) AS prediction
FROM seen WHERE event_id % 3 > 0 AND value / (event_id % 3) > 30""")
def stream_alerts(spark, sf):
    rows = spark.read.parquet(f"{_late_tables(spark, sf, 30.0)}/alerts")
    return rows.select("host", F.unix_micros("time").alias("time"), r6("prediction"))


@query("SELECT CAST(user_id AS VARCHAR) AS host, " + ", ".join(
    f"coalesce(arg_max(event_id, ts) FILTER (event_type = '{t}'), 0) AS {t}" for t in EVENT_TYPES
) + " FROM events GROUP BY 1")
def stream_counters(spark, sf):
    folder = scratch_path(spark, "counter-files")
    rows = events(spark, sf).select(
        F.col("user_id").cast("string").alias("host"), F.col("event_type").alias("name"), F.unix_micros("ts").alias("seq"), F.col("event_id").alias("value")
    )
    # A counter's values are spread over all files, so its newest comes in any of them.
    rows.withColumn("file", F.pmod(F.xxhash64("value"), F.lit(FEW_SLICES))).repartition("file").write.partitionBy("file").parquet(folder)
    files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    changes, out = live.stream_counters(files.select(*rows.columns)), scratch_path(spark, "counters")
    live.start_counters(changes, out, f"{out}-state", available_now=True).awaitTermination()
    return live.latest_counters(spark, out, changes.schema, EVENT_TYPES)


@query()
def stream_score(spark, sf):
    steps = 6
    batch = snapshot_rates(as_snapshots(events(spark, sf)), span=SPAN)
    data, mm = _stored(spark, *jobs.training_set(batch, run="host", steps=steps, horizon=4, span=SPAN))
    model = md.fit_gbt(data.where("split = 'train'"), maxIter=3, maxDepth=3)
    scored = live.stream_score(live.stream_features(_event_stream(spark, sf), steps), model, mm)
    return _run(spark, scored, "scores").withColumn("time", F.unix_micros("time"))
