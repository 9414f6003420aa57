"""One table per metric log: (run_id, time, values), one row per second.

Every function takes the lines of one log format. Sums, extremes and last values
are plain aggregates, so Spark reduces them before the shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlat.functions.numbers import link_pct, ratio
from netlat.functions.text import (
    FRACTION_HEADER,
    contains_any,
    counter_value,
    found,
    has_clock,
    int_sum,
    kv,
    once,
    stamped,
    token,
    words,
)
from netlat.operators.sections import line_class, narrow_lines, skip_head, timed_logs, timed_rows
from netlat.operators.series import counter_delta

SECOND = ["run_id", "time"]
PLACE = ["block", "line_no"]
RULER = "====="


def _last(c: str):
    """Last value in file order."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*PLACE)))


def _zero(c):
    return F.coalesce(c, F.lit(0).cast("bigint"))


# What is read out of the lines of each log: the text of headers, and the values.


def counter_lines(lines: DataFrame, rule: str = "trailing") -> DataFrame:
    return narrow_lines(lines, F.when(has_clock("value"), F.col("value")), {"n": counter_value("value", rule)})


def traffic_lines(lines: DataFrame, rule: str = "trailing") -> DataFrame:
    n = counter_value("value", rule)
    tx, rx = F.col("value").contains("tx_bytes"), F.col("value").contains("rx_bytes")
    return narrow_lines(lines, F.when(has_clock("value"), F.col("value")), {"tx": F.when(tx, n), "rx": F.when(rx & ~tx, n)})


def socket_lines(lines: DataFrame) -> DataFrame:
    value = F.col("value")
    established = value.contains("ESTAB") & ~value.startswith(RULER)
    lines = once(lines, {"_w": F.when(established, words("value"))})
    # A row counts only when both queue lengths are numbers.
    recv, send = (F.try_element_at("_w", F.lit(i + 1)).try_cast("bigint") for i in (1, 2))
    queues = F.when(established & recv.isNotNull() & send.isNotNull(), F.struct(recv.alias("recv"), send.alias("send")))
    window = value.contains("cwnd:")
    read = {"queues": queues, "cwnd": F.when(window, kv("value", "cwnd")), "ssthresh": F.when(window, kv("value", "ssthresh"))}
    return narrow_lines(lines, F.when(value.startswith(RULER) & has_clock("value"), value), read)


def softirq_lines(lines: DataFrame) -> DataFrame:
    rx, tx = F.col("value").contains("NET_RX:"), F.col("value").contains("NET_TX:")
    n = int_sum("value")
    return narrow_lines(lines, F.when(_fraction_header(), F.col("value")), {"rx": F.when(rx, n), "tx": F.when(tx & ~rx, n)})


def throttle_lines(lines: DataFrame) -> DataFrame:
    n = F.when(F.col("value").contains("nr_throttled"), token("value", 1, type="bigint"))
    return narrow_lines(lines, F.when(F.col("value").startswith(RULER) & has_clock("value"), F.col("value")), {"n": n})


def rtt_lines(lines: DataFrame, header_lines: int = 2) -> DataFrame:
    """Each line has its own clock; lines of five columns or fewer are left out."""
    rows = once(skip_head(lines, header_lines) if header_lines else lines, {"_w": words("value")})
    ms = F.try_element_at("_w", F.lit(-1)).try_cast("double")
    rows = rows.where((F.size("_w") > 5) & has_clock("value") & ms.isNotNull())
    return narrow_lines(rows, F.col("value"), {"ms": ms})


def number_lines(lines: DataFrame, at: int, need: int) -> DataFrame:
    """Number `at` of the values after the fourth column; a line with fewer than `need`
    values or a bad one is skipped. The clock stands in the second column."""
    cells = once(lines, {"_w": words("value")})
    values = F.transform(F.slice("_w", F.lit(5), F.greatest(F.size("_w") - 4, F.lit(0))), lambda x: x.try_cast("bigint"))
    when = F.concat_ws(" ", F.try_element_at("_w", F.lit(1)), F.try_element_at("_w", F.lit(2)))
    rows = once(cells, {"_when": when, "_v": values}).select("run_id", "file", *PLACE, "_when", "_v")
    rows = rows.where((F.size("_v") > need) & F.forall("_v", lambda x: x.isNotNull()))
    return narrow_lines(rows, F.when(has_clock("_when"), F.col("_when")), {"n": F.element_at("_v", at + 1)})


# What is made of those rows, one row per second.


def own_clock(rows: DataFrame) -> DataFrame:
    """Rows whose own line holds their time; one that cannot be read gives none."""
    return rows.where("section.block = block AND section.line_no = line_no")


def sums(rows: DataFrame, name: str) -> DataFrame:
    return rows.where("n IS NOT NULL").groupBy(*SECOND).agg(F.sum("n").alias(name))


def link_use(rows: DataFrame, bps: int = 10**9) -> DataFrame:
    used = rows.groupBy(*SECOND, "section").agg(link_pct(_zero(_last("tx")) + _zero(_last("rx")), bps).alias("pct"))
    return used.groupBy(*SECOND).agg(F.avg("pct").alias("nic_usage_pct"))


def extremes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SECOND).agg(
        _zero(F.max("queues.recv")).alias("Recv_Q_Bytes_max"),
        _zero(F.max("queues.send")).alias("Send_Q_Bytes_max"),
        _zero(F.min("cwnd")).alias("cwnd_min"),
        _zero(F.min("ssthresh")).alias("ssthresh_min"),
    )


def interrupts(rows: DataFrame) -> DataFrame:
    both = rows.groupBy(*SECOND).agg(_zero(_last("rx")).alias("rx"), _zero(_last("tx")).alias("tx"))
    return both.where((F.col("rx") > 0) | (F.col("tx") > 0))


def means(rows: DataFrame, name: str = "RTT_ms_mean") -> DataFrame:
    return rows.where("ms IS NOT NULL").groupBy(*SECOND).agg(F.avg("ms").alias(name))


def last_numbers(rows: DataFrame, name: str) -> DataFrame:
    """The last number of a second counts."""
    return rows.where("n IS NOT NULL").groupBy(*SECOND).agg(_last("n").alias(name))


def all_series(logs: dict[str, DataFrame], rule: str = "trailing", bps: int = 10**9, header_lines: int = 2, fail_index: int = 6, drop_index: int = 20) -> dict[str, DataFrame]:
    """The series of all logs with a clock, their text read in one pass: one row per
    second each, counters as they stand."""
    snmp, netstat = connection_lines(logs["conn_fail"])
    rows = timed_logs(
        {
            "throughput": traffic_lines(logs["throughput"], rule),
            **{n: counter_lines(logs[n], rule) for n in ("packets", "retrans", "mem_events")},
            "sockets": socket_lines(logs["sockets"]),
            "fails": number_lines(snmp, fail_index, max(7, fail_index)),
            "drops": number_lines(netstat, drop_index, max(20, drop_index)),
            "softirqs": softirq_lines(logs["softirqs"]),
            "rtt": rtt_lines(logs["rtt"], header_lines),
            "throttle": throttle_lines(logs["throttle"]),
        }
    )
    return {
        "nic": link_use(rows["throughput"], bps),
        "packets": sums(rows["packets"], "total_packets_per_sec"),
        "retrans": sums(rows["retrans"], "retrans_count"),
        "mem_events": sums(rows["mem_events"], "total_mem_events_per_sec"),
        "sockets": extremes(rows["sockets"]),
        "fails": last_numbers(own_clock(rows["fails"]), "fails"),
        "drops": last_numbers(own_clock(rows["drops"]), "drops"),
        "softirq": interrupts(rows["softirqs"]),
        "rtt": means(own_clock(rows["rtt"])),
        "throttle": last_numbers(rows["throttle"], "cpu_throttle"),
    }


def sum_per_second(lines: DataFrame, name: str, rule: str = "trailing") -> DataFrame:
    """Sum of the counters of all processes in each second."""
    return sums(timed_rows(counter_lines(lines, rule), ["n"]), name)


def nic_usage(lines: DataFrame, bps: int = 10**9, rule: str = "trailing") -> DataFrame:
    """Link use in percent: last sent and received bytes of each section, mean
    over the sections of a second."""
    return link_use(timed_rows(traffic_lines(lines, rule), ["tx", "rx"]), bps)


def socket_extremes(lines: DataFrame) -> DataFrame:
    """Longest queues and smallest windows of the established sockets, 0 where a
    section has none."""
    return extremes(timed_rows(socket_lines(lines), ["queues", "cwnd", "ssthresh"]))


def mean_per_second(lines: DataFrame, name: str = "RTT_ms_mean", header_lines: int = 2) -> DataFrame:
    """Mean of the last column in each second, over lines of more than five
    columns that hold a clock."""
    ms = token("value", -1)
    rows = skip_head(lines, header_lines) if header_lines else lines
    rows = rows.where((F.size(words("value")) > 5) & has_clock("value") & ms.isNotNull())
    place = [c for c in ("file", *PLACE) if c in rows.columns]
    rows = stamped(rows.select("run_id", *place, "value", ms.alias("_ms")), F.col("value"))
    return rows.groupBy(*SECOND).agg(F.avg("_ms").alias(name))


def connection_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with failed attempts, and lines with listen drops."""
    netstat = line_class(lines, "NETSTAT", "TcpExt:").where(
        ~(F.col("value").contains("SNMP") & F.col("value").contains("Tcp:"))
    )
    return line_class(lines, "SNMP", "Tcp:"), netstat


def connection_counters(lines: DataFrame, fail_index: int = 6, drop_index: int = 20) -> dict[str, DataFrame]:
    """Cumulative failed attempts and listen drops, each on its own seconds. The
    places depend on the kernel that wrote the log."""
    snmp, netstat = connection_lines(lines)
    rows = timed_logs({
        "fails": number_lines(snmp, fail_index, max(7, fail_index)), "drops": number_lines(netstat, drop_index, max(20, drop_index))
    })
    return {name: last_numbers(own_clock(rows[name]), name) for name in ("fails", "drops")}


def pair_counters(a: DataFrame, b: DataFrame, keys=SECOND) -> DataFrame:
    """Full outer join of two counters, missing values 0."""
    return a.join(b, list(keys), "full").fillna(0)


def connection_rates(counters: dict[str, DataFrame], fill_first: bool = False) -> DataFrame:
    """Failed attempts and listen drops per sample.

    Each counter is differenced over its own samples and joined afterwards. With
    `fill_first` missing samples count as 0 before the difference, as in tables
    made by zero-filling first.
    """
    fails, drops = counters["fails"], counters["drops"]
    if fill_first:
        both = counter_delta(pair_counters(fails, drops), ["fails", "drops"], "run_id", "time")
    else:
        both = pair_counters(
            counter_delta(fails, "fails", "run_id", "time").drop("fails"),
            counter_delta(drops, "drops", "run_id", "time").drop("drops"),
        )
    return both.select(
        *SECOND,
        F.col("fails_per_sec").alias("conn_fail_rate_server"),
        F.col("drops_per_sec").alias("listen_drops_per_sec"),
    )


def _fraction_header():
    return F.col("value").contains(RULER) & F.col("value").rlike(FRACTION_HEADER)


def softirq_sums(lines: DataFrame) -> DataFrame:
    """Receive and send interrupts over all processors, cumulative; samples where
    both are 0 are dropped."""
    return interrupts(timed_rows(softirq_lines(lines), ["rx", "tx"]))


def softirq_rates(sums: DataFrame) -> DataFrame:
    """Interrupts per sample from the cumulative sums."""
    rates = counter_delta(sums, ["rx", "tx"], "run_id", "time")
    return rates.select(
        *SECOND,
        F.col("rx_per_sec").alias("softirq_net_rx_per_sec"),
        F.col("tx_per_sec").alias("softirq_net_tx_per_sec"),
    )


def throttle_totals(lines: DataFrame) -> DataFrame:
    """Throttled periods, cumulative."""
    return last_numbers(timed_rows(throttle_lines(lines), ["n"]), "cpu_throttle")


def throttle_rates(totals: DataFrame) -> DataFrame:
    """Throttled periods per sample."""
    return counter_delta(totals, "cpu_throttle", "run_id", "time").drop("cpu_throttle")


def loss_rate(packets: DataFrame, retrans: DataFrame, keys=SECOND) -> DataFrame:
    """Retransmits next to the packets of the same second, and their share in
    percent. Seconds without a retransmit have 0."""
    return loss_columns(packets.join(retrans, list(keys), "left"), keys)


def loss_columns(df: DataFrame, keys=SECOND) -> DataFrame:
    return df.fillna(0, ["retrans_count"]).select(
        *keys,
        "total_packets_per_sec",
        ratio("retrans_count", "total_packets_per_sec", 100).alias("packet_loss_rate_pct"),
        F.col("retrans_count").alias("retrans_segs_per_sec"),
    )


def run_queue_samples(lines: DataFrame) -> DataFrame:
    """Run queue lengths in file order; the clock of these lines is not used."""
    value = F.col("value")
    parts = F.filter(F.split("value", ","), lambda x: F.trim(x) != "")
    length = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("bigint")
    rows = lines.where(~contains_any(value, RULER, "timestamp", "swpd"))
    return rows.select("run_id", "block", "line_no", length.alias("run_queue_len_cpu0")).where(
        F.col("run_queue_len_cpu0").isNotNull()
    )


def disk_samples(
    lines: DataFrame, device: str | None = None, await_at: int = -6, queue_at: int = -4, min_tokens: int = 14
) -> DataFrame:
    """Read wait and queue length of the disk in file order.

    By default every line that names an sda or nvme disk is a sample; with
    `device` only lines of that disk are, which is right on hosts with several.
    """
    mine = token("value", 0, type="string") == device if device else contains_any("value", "sda", "nvme")
    rows = lines.where(mine & (F.size(words("value")) >= min_tokens)).select(
        "run_id",
        "block",
        "line_no",
        token("value", await_at).alias("iostat_r_await"),
        token("value", queue_at).alias("iostat_aqu_sz"),
    )
    return rows.where(F.col("iostat_r_await").isNotNull() & F.col("iostat_aqu_sz").isNotNull())


def phase_starts(lines: DataFrame) -> DataFrame:
    """Start and 0/1 label of each phase; of equal starts the later line wins.

    A line is cut at its first comma. Lines without a clock are left out.
    """
    first = found("value", r"^([^,]*),")
    label = F.upper(found("value", r"^[^,]*,(.*)$")).contains("ATTACK").cast("int")
    rows = lines.where(has_clock(first)).select("run_id", "file", *PLACE, first.alias("_first"), label.alias("_label"))
    rows = stamped(rows, F.col("_first"), "start")
    return rows.groupBy("run_id", "start").agg(F.max_by(F.coalesce("_label", F.lit(0)), F.struct(*PLACE)).alias("label"))


def reject_counts(lines: DataFrame, accepted) -> DataFrame:
    """Lines per file that a rule took and did not take."""
    return lines.groupBy("run_id", "file").agg(
        F.count_if(accepted).alias("accepted"), F.count_if(~F.coalesce(accepted, F.lit(False))).alias("rejected")
    )
