"""Column lists and declared schemas shared by the whole package."""

from pyspark.sql import types as T

# The feature order is part of the model contract.
FEATURES = [
    "RTT_ms_mean",
    "packet_loss_rate_pct",
    "retrans_segs_per_sec",
    "conn_fail_rate_server",
    "listen_drops_per_sec",
    "Recv_Q_Bytes_max",
    "Send_Q_Bytes_max",
    "run_queue_len_cpu0",
    "cwnd_min",
    "ssthresh_min",
    "nic_usage_pct",
    "total_packets_per_sec",
    "used_MB",
    "available_MB",
    "total_mem_events_per_sec",
    "cpu_throttle_per_sec",
    "softirq_net_rx_per_sec",
    "softirq_net_tx_per_sec",
    "iostat_r_await",
    "iostat_aqu_sz",
]
TARGET = "RTT_ms_mean"
LABEL = "Label"
# The four key indicators of the monitor view, in display order.
KPIS = ["RTT_ms_mean", "nic_usage_pct", "used_MB", "total_packets_per_sec"]

# The names of a snapshot.
GAUGES = ["tcp_rtt_sum", "mem_total_mb", "mem_avail_mb", "sched_run_queue"]
# Snapshot values that are read as they are.
LEVELS = ["tcp_rtt_count", "tcp_recv_q_max", "tcp_send_q_max", "tcp_cwnd_min", "tcp_ssthresh_min"]
# Snapshot values that only grow and are differenced.
COUNTERS = [
    "snmp_ActiveOpens",
    "snmp_PassiveOpens",
    "snmp_AttemptFails",
    "snmp_RetransSegs",
    "snmp_ListenDrops",
    "nic_rx_bytes",
    "nic_tx_bytes",
    "disk_read_ios",
    "disk_read_time_ms",
    "disk_io_weighted_ms",
    "cpu_nr_throttled",
    "softirq_net_rx",
    "softirq_net_tx",
    "ebpf_packet_count",
    "ebpf_retrans_count",
    "ebpf_mem_events",
    "ebpf_tx_attempts",
]


def _struct(names, kind):
    return [T.StructField(n, kind) for n in names]


FEATURE_SCHEMA = T.StructType(
    [T.StructField("run_id", T.StringType()), T.StructField("time", T.TimestampType())]
    + _struct(FEATURES, T.DoubleType())
    + [T.StructField(LABEL, T.IntegerType())]
)

SNAPSHOT_SCHEMA = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("timestamp", T.TimestampType())]
    + _struct(GAUGES, T.DoubleType())
    + _struct(LEVELS + COUNTERS, T.LongType())
)

CONN_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("uid", T.StringType()),
        T.StructField("id.orig_h", T.StringType()),
        T.StructField("id.orig_p", T.IntegerType()),
        T.StructField("id.resp_h", T.StringType()),
        T.StructField("id.resp_p", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("orig_bytes", T.LongType()),
        T.StructField("resp_bytes", T.LongType()),
        T.StructField("conn_state", T.StringType()),
    ]
)

SSL_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("uid", T.StringType()),
        T.StructField("id.orig_h", T.StringType()),
        T.StructField("id.orig_p", T.IntegerType()),
        T.StructField("id.resp_h", T.StringType()),
        T.StructField("id.resp_p", T.IntegerType()),
        T.StructField("version", T.StringType()),
        T.StructField("cipher", T.StringType()),
        T.StructField("curve", T.StringType()),
        T.StructField("server_name", T.StringType()),
    ]
)
