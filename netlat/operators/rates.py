"""Feature rows from raw counter snapshots."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlat.functions.numbers import clip0, ratio
from netlat.operators.series import CHUNK_ROWS, names, over_series
from netlat.schemas import COUNTERS, FEATURES


def features_of(now, grown, seconds, link_bps: float, ratio, rate) -> dict:
    """The 20 features of snapshots, for columns and for arrays alike.

    `now` gives a value as it stands, `grown` the growth of a counter since the snapshot
    before, `seconds` the time between the two; `ratio(n, d, scale)` is 0 without a
    positive d, and `rate` makes 0 of what a first snapshot has no value for. The loss
    rate is retransmits per queued packet, the fail rate drops per drop or accepted
    connection.
    """
    drops, opens = grown("snmp_ListenDrops"), grown("snmp_PassiveOpens")
    bits = (grown("nic_rx_bytes") + grown("nic_tx_bytes")) * 8.0
    per_second = lambda counter: rate(grown(counter) * 1.0 / seconds)
    return {
        "RTT_ms_mean": ratio(now("tcp_rtt_sum"), now("tcp_rtt_count"), 1),
        "packet_loss_rate_pct": rate(ratio(grown("ebpf_retrans_count"), grown("ebpf_tx_attempts"), 100)),
        "retrans_segs_per_sec": per_second("ebpf_retrans_count"),
        "conn_fail_rate_server": rate(ratio(drops, drops + opens, 100)),
        "listen_drops_per_sec": per_second("snmp_ListenDrops"),
        "Recv_Q_Bytes_max": now("tcp_recv_q_max"),
        "Send_Q_Bytes_max": now("tcp_send_q_max"),
        "run_queue_len_cpu0": now("sched_run_queue"),
        "cwnd_min": now("tcp_cwnd_min"),
        "ssthresh_min": now("tcp_ssthresh_min"),
        "nic_usage_pct": rate(bits / (seconds * float(link_bps)) * 100),
        "total_packets_per_sec": per_second("ebpf_packet_count"),
        "used_MB": now("mem_total_mb") - now("mem_avail_mb"),
        "available_MB": now("mem_avail_mb"),
        "total_mem_events_per_sec": per_second("ebpf_mem_events"),
        "cpu_throttle_per_sec": per_second("cpu_nr_throttled"),
        "softirq_net_rx_per_sec": per_second("softirq_net_rx"),
        "softirq_net_tx_per_sec": per_second("softirq_net_tx"),
        "iostat_r_await": rate(ratio(grown("disk_read_time_ms"), grown("disk_read_ios"), 1)),
        "iostat_aqu_sz": rate(grown("disk_io_weighted_ms") * 1.0 / (seconds * 1000)),
    }


def rate_columns(delta, seconds: Column, first: Column, link_bps: float) -> dict[str, Column]:
    """features_of as columns; `first` tells the first snapshot of a host."""
    rate = lambda expression: F.when(first, F.lit(0.0)).otherwise(expression)
    made = features_of(F.col, delta, seconds, link_bps, ratio, rate)
    return {name: made[name].cast("double") for name in FEATURES}


def snapshot_rates(
    df: DataFrame, host="host", ts: str = "timestamp", link_bps: float = 1e9, clip: bool = True, span: float = 3600,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rates between successive snapshots of a host.

    Equal times count as one second apart. Counters that fall, as after a
    restart, count as unchanged unless `clip` is off.
    """
    host = names(host)
    columns = {f"_before_{c}": (lambda c: lambda w: F.lag(c, 1).over(w))(c) for c in [ts, *COUNTERS]}
    paired = over_series(df, host, ts, columns, back=1, span=span, rows=rows)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = (micros(ts) - micros(f"_before_{ts}")) / 1_000_000.0

    def delta(c):
        growth = F.col(c) - F.col(f"_before_{c}")
        return clip0(growth) if clip else growth

    # Columns of their own, since every feature uses several of them.
    steps = {f"_grown_{c}": delta(c) for c in COUNTERS}
    steps |= {"_seconds": F.when(gap > 0, gap).otherwise(F.lit(1.0)), "_first": F.col(f"_before_{ts}").isNull()}
    grown = paired.withColumns(steps)
    features = rate_columns(lambda c: F.col(f"_grown_{c}"), F.col("_seconds"), F.col("_first"), link_bps)
    return grown.select(*host, F.col(ts).alias("time"), *[c.alias(n) for n, c in features.items()])
