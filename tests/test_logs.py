"""Golden log files: each format, with gaps, repeats, noise and bad lines."""

import pytest
from pyspark.sql import functions as F

from netlat.operators import metrics as mt
from netlat.operators import sections
from netlat.operators.sections import carry_section, drop_containing, skip_head, states
from netlat.operators.snapshots import text_values
from netlat.plans import jobs
from netlat.schemas import CONN_SCHEMA, FEATURES, SSL_SCHEMA
from netlat.session import settle
from netlat.sources.logs import optional, read_lines, read_optional_lines, read_zeek, require
from netlat.sources.tables import parse_mem_usage, read_feature_csv, write_augmented, write_features, write_report

RUN = "AI_TRAINING_DATA_20251122_115950"
DAY = "2025-11-22"


def write(root, name, text, run=RUN):
    folder = root / run
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(root / "*" / name)


def table(df, *cols):
    """Rows as tuples with the clock for the time."""
    out = df.select(F.date_format("time", "HH:mm:ss").alias("time"), *cols).orderBy("time").collect()
    return [tuple(r) for r in out]


def test_counters_of_all_processes_are_summed(spark, tmp_path):
    path = write(
        tmp_path,
        "packets_count.log",
        "Attaching 2 probes...\n@[early]: 99\n12:00:01 @[nginx]: 5\n@[kworker/0:1]: 12\n"
        "\x1b[32m12:00:02 @[nginx]: 7\x1b[0m\n@[bad]: x\n12:00:04 \n12:00:02 @[again]: 1\n",
    )
    lines = read_lines(spark, path)
    assert table(mt.sum_per_second(lines, "n"), "n") == [("12:00:01", 17), ("12:00:02", 8)]
    # The first-colon rule reads minutes and processor numbers.
    assert table(mt.sum_per_second(lines, "n", "first_colon"), "n") == [("12:00:01", 1), ("12:00:02", 0), ("12:00:04", 0)]


def test_nic_usage_takes_the_mean_of_repeated_seconds(spark, tmp_path):
    path = write(
        tmp_path,
        "throughput.log",
        "12:00:01 @tx_bytes: 1000\n@rx_bytes: 3000\n12:00:02 @tx_bytes: 500\n12:00:02 @tx_bytes: 500\n@rx_bytes: 1000\n12:00:03\n",
    )
    got = table(mt.nic_usage(read_lines(spark, path)), F.round("nic_usage_pct", 8))
    assert got == [("12:00:01", 0.0032), ("12:00:02", 0.0008), ("12:00:03", 0.0)]


def test_socket_extremes(spark, tmp_path):
    path = write(
        tmp_path,
        "tcp_ss_detail.log",
        f"ESTAB 9 9 before any header\n===== {DAY} 12:00:01 =====\nState Recv-Q Send-Q\nESTAB 0 128 10.0.0.1:80 10.0.0.2:5000\n"
        "\t cubic rtt:1.5/0.7 cwnd:10 ssthresh:7\nESTAB 40 x 10.0.0.1:80 10.0.0.2:5001\nESTAB 30 2 a b\n\t cubic cwnd:4\n\n"
        f"===== {DAY} 12:00:02 =====\nState Recv-Q\n",
    )
    cols = ["Recv_Q_Bytes_max", "Send_Q_Bytes_max", "cwnd_min", "ssthresh_min"]
    assert table(mt.socket_extremes(read_lines(spark, path)), *cols) == [
        ("12:00:01", 30, 128, 4, 7),
        ("12:00:02", 0, 0, 0, 0),
    ]


def conn_line(clock, kind, name, values):
    return f"{DAY} {clock}.123 {kind} {name}: " + " ".join(str(v) for v in values)


def test_connection_counters_difference_their_own_samples(spark, tmp_path):
    snmp = lambda clock, n: conn_line(clock, "SNMP", "Tcp", [1, 200, 120000, -1, 50, 60, n, 4, 5, 6])
    net = lambda clock, n: conn_line(clock, "NETSTAT", "TcpExt", [0] * 20 + [n, 1])
    text = "\n".join(
        ["# timestamp Tcp_line Netstat_line", snmp("12:00:01", 10), net("12:00:01", 5), snmp("12:00:02", 14), snmp("12:00:02", 15)]
        + [conn_line("12:00:03", "SNMP", "Tcp", [1, 2]), net("12:00:03", 9), snmp("12:00:04", 3), net("12:00:04", "x")]
    )
    path = write(tmp_path, "conn_fail_stats.log", text + "\n")
    counters = {k: settle(v) for k, v in mt.connection_counters(read_lines(spark, path)).items()}
    got = table(mt.connection_rates(counters), "conn_fail_rate_server", "listen_drops_per_sec")
    assert got == [("12:00:01", 0, 0), ("12:00:02", 5, 0), ("12:00:03", 0, 4), ("12:00:04", 0, 0)]
    # Zero-filling first makes a gap look like a fall and a jump.
    filled = table(mt.connection_rates(counters, fill_first=True), "conn_fail_rate_server", "listen_drops_per_sec")
    assert filled == [("12:00:01", 0, 0), ("12:00:02", 5, 0), ("12:00:03", 0, 9), ("12:00:04", 3, 0)]


def test_softirqs_and_throttling(spark, tmp_path):
    block = lambda clock, rx, tx: f"===== {DAY} {clock}.123 =====\n   CPU0  CPU1\n NET_TX: {tx} 1\n NET_RX: {rx} 2\n\n"
    path = write(
        tmp_path,
        "softirqs.log",
        "# timestamp /proc/softirqs\n" + block("12:00:01", 10, 5) + block("12:00:02", 15, 5)
        + f"===== {DAY} 12:00:03.000 =====\n NET_TX: 0 0\n NET_RX: 0 0\n" + block("12:00:04", 4, 9),
    )
    sums = mt.softirq_sums(read_lines(spark, path))
    assert table(sums, "rx", "tx") == [("12:00:01", 12, 6), ("12:00:02", 17, 6), ("12:00:04", 6, 10)]
    rates = table(mt.softirq_rates(sums), "softirq_net_rx_per_sec", "softirq_net_tx_per_sec")
    assert rates == [("12:00:01", 0, 0), ("12:00:02", 5, 0), ("12:00:04", 0, 4)]
    path = write(
        tmp_path,
        "cpu_throttle.log",
        f"nr_throttled 99\n===== {DAY} 12:00:01.1 =====\nnr_periods 1\nnr_throttled 4\n===== {DAY} 12:00:02.1 =====\nnr_throttled 9\n"
        f"===== {DAY} 12:00:03.1 =====\nnr_throttled 2\n",
    )
    got = table(mt.throttle_rates(mt.throttle_totals(read_lines(spark, path))), "cpu_throttle_per_sec")
    assert got == [("12:00:01", 0), ("12:00:02", 5), ("12:00:03", 0)]


def test_rtt_skips_two_lines_of_each_file(spark, tmp_path):
    row = lambda clock, ms: f"{clock} 812 nginx 10.0.0.1 80 10.0.0.2 4433 1 2 {ms}\n"
    head = "TIME PID COMM LADDR LPORT RADDR RPORT TX_KB RX_KB MS\n"
    path = write(tmp_path, "rtt_log.txt", head + row("12:00:00", 900) + row("12:00:01", 2) + row("12:00:01", 4) + row("12:00:02", "-"))
    write(tmp_path, "rtt_log.txt", head + row("12:00:00", 1) + row("12:00:01", 8) + "12:00:01 short 5\n", run="run_b_20251122_120000")
    got = mt.mean_per_second(read_lines(spark, path)).orderBy("run_id").collect()
    assert [(r.run_id[:3], r.RTT_ms_mean) for r in got] == [("AI_", 3.0), ("run", 8.0)]


def test_positional_logs(spark, tmp_path):
    path = write(tmp_path, "vmstat.log", "===== 12:00:01 =====\n12:00:01,3,0,1\n===== 12:00:02 =====\n12:00:02,x,0\n\nr,swpd\n12:00:02,5,1\n")
    got = mt.run_queue_samples(read_lines(spark, path)).orderBy("block", "line_no").collect()
    assert [r.run_queue_len_cpu0 for r in got] == [3, 5]
    disk = lambda name, a, q: f"{name} " + " ".join(["1"] * 8 + [str(a), "0", str(q), "0", "0", "0"][0:6]) + "\n"
    path = write(tmp_path, "iostat.log", "# timestamp iostat\nDevice r/s\n" + disk("sda", 1.5, 0.25) + disk("nvme0n1", 2.5, 0.5) + disk("sdb", 9, 9) + "sda 1 2\n")
    lines = read_lines(spark, path)
    pick = lambda df: [(r.iostat_r_await, r.iostat_aqu_sz) for r in df.orderBy("block", "line_no").collect()]
    assert pick(mt.disk_samples(lines)) == [(1.5, 0.25), (2.5, 0.5)]
    assert pick(mt.disk_samples(lines, device="nvme0n1")) == [(2.5, 0.5)]


def test_phases(spark, tmp_path):
    path = write(tmp_path, "scenario_timeline.txt", "12:00:00,NORMAL\n12:00:02,attack,two\nbad,ATTACK\n12:00:02,Attack\n12:00:04,NORMAL\nno comma\n")
    got = [(r.start.strftime("%H:%M:%S"), r.label) for r in mt.phase_starts(read_lines(spark, path)).orderBy("start").collect()]
    assert got == [("12:00:00", 0), ("12:00:02", 1), ("12:00:04", 0)]


def test_clock_after_midnight_is_the_next_day(spark, tmp_path):
    path = write(tmp_path, "mem_event.log", "23:59:59 @[a]: 1\n00:00:01 @[a]: 2\n", run="R_20251122_235950")
    got = mt.sum_per_second(read_lines(spark, path), "n").orderBy("time").collect()
    assert [(str(r.time), r.n) for r in got] == [("2025-11-22 23:59:59", 1), ("2025-11-23 00:00:01", 2)]


def test_memory_rows_without_a_clock_are_dropped(spark, tmp_path):
    head = "timestamp,total_MB,used_MB,free_MB,shared_MB,buff_cache_MB,available_MB\n"
    path = write(tmp_path, "mem_usage.csv", head + f"{DAY} 12:00:01.100,9,1,2,3,4,5\n{DAY} 12:00:01.900,9,7,2,3,4,6\nlost,9,1,1,1,1,1\n")
    assert table(parse_mem_usage(spark, path), "used_MB", "available_MB") == [("12:00:01", 7, 6)]


def test_split_files_keep_order_and_headers(spark, tmp_path):
    """A file read in many pieces gives the same sections as in one."""
    text = "".join(f"12:{m:02d}:{s:02d} @[a]: {s}\n" + "".join(f"@[p{i}]: {i}\n" for i in range(40)) for m in range(4) for s in range(60))
    path = write(tmp_path, "mem_event.log", text)
    whole = table(mt.sum_per_second(read_lines(spark, path), "n"), "n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = read_lines(spark, path)
        assert lines.select("block").distinct().count() > 20
        assert table(mt.sum_per_second(lines, "n"), "n") == whole
        heads = carry_section(lines).groupBy("section").count()
        assert heads.where("count <> 41").count() == 0
        assert skip_head(lines, 2).count() == lines.count() - 2
        assert min(r[0] for r in skip_head(lines, 2).where("block = 0").select("line_no").collect()) == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(whole) == 240 and whole[5] == ("12:00:05", 5 + sum(range(40)))


def full_run(root, run=RUN):
    write(root, "packets_count.log", "12:00:01 @[nginx]: 100\n12:00:02 @[nginx]: 200\n12:00:03 @[nginx]: 0\n", run)
    write(root, "retrans_bpftrace.log", "12:00:02 @[nginx]: 5\n12:00:09 @[nginx]: 5\n", run)
    write(root, "throughput.log", "12:00:01 @tx_bytes: 1000\n@rx_bytes: 3000\n", run)
    write(root, "tcp_ss_detail.log", f"===== {DAY} 12:00:02 =====\nESTAB 7 8 a b\n\t cwnd:3 ssthresh:2\n", run)
    write(root, "mem_usage.csv", f"timestamp,total_MB,used_MB,free_MB,shared_MB,buff_cache_MB,available_MB\n{DAY} 12:00:04.5,9,1,2,3,4,5\n", run)
    write(root, "cpu_throttle.log", f"===== {DAY} 12:00:01.1 =====\nnr_throttled 4\n===== {DAY} 12:00:03.1 =====\nnr_throttled 6\n", run)
    write(root, "vmstat.log", "12:11:11,3,0\n12:11:12,4,0\n", run)
    write(root, "iostat.log", "".join("sda " + "1 " * 7 + f"{i} 0 {i}.5 0 0 0\n" for i in range(9)), run)
    write(root, "scenario_timeline.txt", "12:00:00,NORMAL\n12:00:02,ATTACK\n12:00:04,NORMAL\n", run)


def test_no_run_log_at_all_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no run log"):
        jobs.run_features(spark, str(tmp_path))


def test_run_features_end_to_end(spark, tmp_path):
    full_run(tmp_path)
    full_run(tmp_path, "OTHER_20251122_115950")
    out = settle(jobs.run_features(spark, str(tmp_path)))
    assert out.columns == ["run_id", "time", *FEATURES, "Label"]
    assert out.count() == 8
    cols = ["total_packets_per_sec", "packet_loss_rate_pct", "retrans_segs_per_sec", "nic_usage_pct", "Recv_Q_Bytes_max",
            "cwnd_min", "used_MB", "cpu_throttle_per_sec", "run_queue_len_cpu0", "iostat_r_await", "iostat_aqu_sz", "Label"]
    for run in (RUN, "OTHER_20251122_115950"):
        got = table(out.where(F.col("run_id") == run), *[F.round(c, 8) for c in cols])
        assert got == [
            ("12:00:01", 100, 0, 0, 0.0032, 0, 0, 0, 0, 3, 0, 0.5, 0),
            ("12:00:02", 200, 2.5, 5, 0, 7, 3, 0, 0, 4, 1, 1.5, 1),
            ("12:00:03", 0, 0, 0, 0, 0, 0, 0, 2, 0, 2, 2.5, 1),
            ("12:00:04", 0, 0, 0, 0, 0, 0, 1, 0, 0, 3, 3.5, 0),
        ]
    path = str(tmp_path / "features")
    write_features(out, path)
    assert spark.read.parquet(path).count() == 8
    csv = str(tmp_path / "csv")
    out.where(F.col("run_id") == RUN).drop("run_id").orderBy("time").coalesce(1).write.csv(csv, header=True)
    back = read_feature_csv(spark, csv)
    assert back.count() == 4 and back.columns == ["run_id", "block", "line_no", "time", *FEATURES, "Label"]
    wide = jobs.augment_files(spark, csv, level=0)
    assert [r.time[11:19] for r in wide.where("k IN (0, 13, 39)").orderBy("k").collect()] == ["12:00:01", "12:00:02", "12:00:04"]
    assert back.agg(F.sum("total_packets_per_sec")).first()[0] == 300


CONN_HEAD = "#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tduration\torig_bytes\tresp_bytes\tconn_state\n"


def conn_row(ts, host="h1", port=443, proto="tcp", duration="-", sent="-", got="-", state="SF"):
    return "\t".join(str(x) for x in [ts, "u", "o", 1, host, port, proto, "ssl", duration, sent, got, state]) + "\n"


def test_connection_report(spark, tmp_path):
    rows = [
        conn_row(1627603200.5, duration=2.0, sent=1024, got=1073741824),
        conn_row(1627606800.0, host="h2", sent=5, got=3145728, state="RSTR"),
        conn_row(1627606801.0, host="h2", port=80, got="-", state="S0", duration=1.0),
        conn_row(1627606802.0, state="OTHSF"),
    ]
    write(tmp_path, "conn.log", CONN_HEAD + "".join(rows) + "#close\n", run="0801")
    write(tmp_path, "conn.log", CONN_HEAD + rows[0], run="0802")
    fields = "#fields\tts\tserver_name\n"
    write(tmp_path, "ssl.log", fields + "1\twww.a\n2\twww.b\n3\twww.a\n", run="0801")
    report = jobs.connection_report(spark, str(tmp_path))
    of = lambda name, *cols: [tuple(r) for r in report[name].where("day = '0801'").orderBy(*cols).collect()]
    assert of("proto_port", "rank") == [("0801", "tcp", 443, 3, 1), ("0801", "tcp", 80, 1, 2)]
    assert of("servers", "rank") == [("0801", "www.a", 2, 1), ("0801", "www.b", 1, 2)]
    assert of("hours", "hour") == [("0801", 0, 1, "*"), ("0801", 1, 3, "*")]
    assert of("abnormal_states", "rank") == [("0801", "S0", 1, 1), ("0801", "RSTR", 1, 2)]
    assert of("mean_duration", "day") == [("0801", 0.75)]
    assert of("response_sizes", "rank")[1:] == [("0801", "3MB", 1, 2), ("0801", "1024MB", 1, 3)]
    top = of("transfers", "rank")[0]
    assert top[2:7] == (1073742848, "1.00GB", "h1", "1.00KB", "1.00GB")
    assert report["proto_port"].where("day = '0802'").count() == 1


def test_zeek_files_with_different_layouts(spark, tmp_path):
    path = write(tmp_path, "conn.log", CONN_HEAD + conn_row(1.0, sent=5), run="0801")
    write(tmp_path, "conn.log", "#fields\torig_bytes\tproto\tts\n7\tudp\t2.0\n", run="0802")
    write(tmp_path, "conn.log", conn_row(3.0, sent=9), run="0803")
    got = read_zeek(spark, path, ["ts", "proto", "orig_bytes", "id.resp_h"], CONN_SCHEMA).orderBy("day").collect()
    assert [tuple(r) for r in got] == [("0801", 1.0, "tcp", 5, "h1"), ("0802", 2.0, "udp", 7, None), ("0803", 3.0, "tcp", 9, "h1")]


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        require(spark, str(tmp_path / "none" / "conn.log"))
    assert read_optional_lines(spark, str(tmp_path / "none" / "*.log")).count() == 0
    assert optional(spark, str(tmp_path / "none.parquet"), SSL_SCHEMA).columns == SSL_SCHEMA.fieldNames()


def test_line_filters(spark):
    df = spark.createDataFrame([("SF",), ("RSTR",), ("OTHSF",), (None,)], ["state"])
    assert sorted(str(r[0]) for r in drop_containing(df, "state", "SF").collect()) == ["None", "RSTR"]
    assert states(df, ["SF", "RSTR"]).count() == 2


def test_a_zeek_file_follows_its_own_header_whatever_the_others_do(spark, tmp_path):
    plain = write(tmp_path, "conn.log", conn_row(1.0, sent=5), run="0801")
    write(tmp_path, "conn.log", "#fields\tproto\tid.resp_p\ntcp\t443\n", run="0802")
    fields = ["ts", "proto", "id.resp_p"]
    for third in (None, "#fields\tts\n3.0\n"):
        if third:
            write(tmp_path, "conn.log", third, run="0803")
        got = read_zeek(spark, plain, fields, CONN_SCHEMA).where("day < '0803'").orderBy("day").collect()
        assert [r["proto"] for r in got] == ["tcp", "tcp"] and got[1]["id_resp_p"] == 443 and got[0]["ts"] == 1.0


def test_a_line_of_very_many_counters(spark, tmp_path):
    many = " ".join(["1"] * 1500)
    path = write(tmp_path, "conn_fail_stats.log", f"{DAY} 12:00:01.5 SNMP Tcp: {many} 77\n{DAY} 12:00:02.5 SNMP Tcp: {many} x\n")
    got = mt.connection_counters(read_lines(spark, path), fail_index=1500)["fails"].collect()
    assert [r["fails"] for r in got] == [77]


@pytest.mark.parametrize(("start", "clocks", "days"), [
    ("000000", ["00:00:01", "13:00:00", "23:59:59"], [0, 0, 0]),
    ("115950", ["11:59:40", "23:00:00", "00:30:00", "11:00:00"], [0, 0, 1, 1]),
    ("220000", ["23:59:59", "00:00:01", "22:30:00", "23:10:00", "00:20:00", "04:00:00"], [0, 1, 1, 1, 2, 2]),
    ("235900", ["00:00:30", "00:00:29", "00:00:31"], [1, 1, 1]),
])
def test_days_of_bare_clocks(spark, tmp_path, start, clocks, days):
    run = f"RUN_20251122_{start}"
    text = "".join(f"{c} @[a]: {k + 1}\n" for k, c in enumerate(clocks))
    lines = read_lines(spark, write(tmp_path, "packets_count.log", text, run=run))
    want = {k + 1: f"2025-11-{22 + d} {c}" for k, (c, d) in enumerate(zip(clocks, days, strict=True))}
    for width in (1, 2, 100):
        # Lines in splits of their file.
        cut = lines.withColumn("block", F.floor(F.col("line_no") / width))
        got = mt.sum_per_second(cut, "n").select("n", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
        assert {r["n"]: r["t"] for r in got} == want


def test_feature_csv_is_read_by_name(spark, tmp_path):
    names = ["Label", *reversed(FEATURES), "time"]
    names[names.index("Recv_Q_Bytes_max")] = "Recv-Q_Bytes_max"
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(map(str, [1, *range(19, -1, -1), "12:00:01"])) + "\n")
    row = read_feature_csv(spark, str(tmp_path / "a.csv")).first()
    assert [row[f] for f in FEATURES] == [float(k) for k in range(20)] and row["time"] == "12:00:01" and row["Label"] == 1
    (tmp_path / "b.csv").write_text("time,Label\n12:00:01,1\n")
    with pytest.raises(Exception, match="no column"):
        read_feature_csv(spark, str(tmp_path / "b.csv")).collect()


def test_snapshot_values_from_text(spark):
    sockets = (
        "State Recv-Q Send-Q rtt:9 cwnd:1\nESTAB 5 x a b\n\t cubic rtt:1.5/0.7 cwnd:10 ssthresh:7\nLISTEN 3 128 a b\n"
        "SYN-SENT 99 99 a b\n\t cubic rtt:2.5/1 cwnd:4\nESTAB 7 8 a\n"
    )
    snmp = "Tcp: RtoAlgorithm " + "n " * 13 + "\nTcp: 1 200 120000 -1 50 60 3 4 5 6 7 8 9\nTcp: 1 2"
    netstat = "TcpExt: " + "n " * 25 + "\nTcpExt: " + " ".join(map(str, range(1, 26)))
    softirqs = "   CPU0 CPU1\n NET_TX: 10 20 x\n NET_RX: 100 200"
    df = spark.createDataFrame([("h", sockets, snmp, netstat, softirqs), ("e", None, "", "TcpExt: x", None)], "host string, sockets string, snmp string, netstat string, softirqs string")
    full, none = (r.asDict() for r in text_values(df).orderBy(F.desc("host")).collect())
    assert full == {
        "host": "h", "tcp_rtt_sum": 4.0, "tcp_rtt_count": 2, "tcp_recv_q_max": 5, "tcp_send_q_max": 128, "tcp_cwnd_min": 4, "tcp_ssthresh_min": 7,
        "snmp_ActiveOpens": 50, "snmp_PassiveOpens": 60, "snmp_AttemptFails": 3, "snmp_RetransSegs": 8, "snmp_ListenDrops": 21,
        "softirq_net_rx": 300, "softirq_net_tx": 30,
    }
    assert none == {"host": "e"} | dict.fromkeys([k for k in full if k != "host"], 0)


def test_text_is_read_once_for_all_logs(spark, tmp_path):
    """The tables of seconds are made from the narrow table, not from the text again."""
    run = tmp_path / "R_20250101_120000"
    run.mkdir()
    for name in ("packets_count.log", "retrans_bpftrace.log"):
        (run / name).write_text("".join(f"12:00:{k:02} @[a]: {k}\n@[b]: 1\n" for k in range(50)))
    lines = read_lines(spark, str(run / "packets_count.log"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan(lines)
    made = mt.sum_per_second(lines, "n")
    assert "FileScan text" not in plan(made)
    assert made.agg(F.sum("n")).first()[0] == sum(range(50)) + 50
    both = sections.timed_logs({n: mt.counter_lines(read_lines(spark, str(run / f))) for n, f in (("p", "packets_count.log"), ("r", "retrans_bpftrace.log"))})
    assert all("FileScan text" not in plan(df) for df in both.values())
    assert {n: mt.sums(df, "n").count() for n, df in both.items()} == {"p": 50, "r": 50}


def files_of(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_a_run_written_again_leaves_the_others(spark, tmp_path):
    times = F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000)
    rows = spark.range(60).select(F.concat(F.lit("r"), F.col("id") % 3).alias("run_id"), times.alias("time"), (F.col("id") * 1.0).alias("x"))
    out = tmp_path / "features"
    write_features(rows, str(out))
    before = files_of(out)
    write_features(rows.where("run_id = 'r1'").withColumn("x", F.col("x") + 100), str(out))
    after = files_of(out)
    assert {f: t for f, t in before.items() if "run_id=r1" not in f} == {f: t for f, t in after.items() if "run_id=r1" not in f}
    back = spark.read.parquet(str(out))
    assert back.count() == 60 and back.where("x >= 100").select("run_id").distinct().collect()[0][0] == "r1"
    # A run has at most a file for each hour.
    for run in ("r0", "r1", "r2"):
        hours = rows.where(f"run_id = '{run}'").select(F.date_trunc("hour", "time")).distinct().count()
        assert sum(f"run_id={run}" in f for f in after) <= hours
    varied = rows.select("run_id", F.lit(1).alias("variation"), F.col("x").cast("bigint").alias("k"), "x")
    write_augmented(varied, str(tmp_path / "aug"), points=30)
    write_augmented(varied.where("run_id = 'r0'"), str(tmp_path / "aug"), points=30)
    assert len(files_of(tmp_path / "aug")) <= 6 and spark.read.parquet(str(tmp_path / "aug")).count() == 60


def test_report_of_new_days_adds_to_the_old(spark, tmp_path):
    conn = lambda days: spark.createDataFrame([(d, float(k), "h", k % 3, "tcp", 1.0, k, k, "SF") for d in days for k in range(20)],
        "day string, ts double, id_resp_h string, id_resp_p int, proto string, duration double, orig_bytes long, resp_bytes long, conn_state string")
    for days in (["0801"], ["0802", "0803"], ["0802"]):
        write_report(jobs.report_sections(conn(days), None), str(tmp_path / "parts"))
    write_report(jobs.report_sections(conn(["0801", "0802", "0803"]), None), str(tmp_path / "whole"))
    for name in ("proto_port", "hours", "transfers", "mean_duration"):
        show = lambda root: sorted(map(str, spark.read.parquet(str(tmp_path / root / name)).collect()))
        assert show("parts") == show("whole") and show("whole")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_read_out_of_a_line_is_worked_out_once(spark):
    lines = spark.createDataFrame([("r", "f", 0, 1, "x")], "run_id string, file string, block long, line_no long, value string")
    assert optimized(mt.socket_lines(lines)).count("ssthresh:(") == 1
    plan = optimized(mt.number_lines(lines, 6, 7))
    assert plan.count("try_cast") + plan.count("tryeval") <= 1 and plan.count("transform(") == 1


def test_a_snapshot_s_texts_are_taken_apart_once(spark):
    schema = "k int, sockets string, snmp string, netstat string, softirqs string"
    sockets = "ESTAB 9 9 a b\nESTAB 3 4 a b\n\t cubic rtt:1.5/2 cwnd:4 ssthresh:6\n  LISTEN 7 x a b\nSYN-SENT 50 50 a b\nESTABLISHED 60 60 a b"
    odd = [(1, sockets, "Tcp: a b\nTcp: 1 2 3 4 5 6 7 8 9 10 11 12 13", None, "h\n NET_RX: 1 2"), (2, "head only", "", "", ""), (3, None, None, None, None), (4, "\nESTAB 1 2 a b", None, None, None)]
    made = text_values(spark.createDataFrame(odd, schema))
    got = {r.k: r for r in made.collect()}
    assert [got[1][c] for c in ("tcp_rtt_sum", "tcp_rtt_count", "tcp_recv_q_max", "tcp_send_q_max", "tcp_cwnd_min", "tcp_ssthresh_min")] == [1.5, 1, 7, 4, 4, 6]
    assert (got[1].snmp_ActiveOpens, got[1].snmp_RetransSegs, got[1].softirq_net_rx) == (5, 12, 3)
    assert set(list(got[2])[1:]) == set(list(got[3])[1:]) == {0} and got[4].tcp_send_q_max == 2
    plan = optimized(made)
    assert plan.count("rtt:(") == 1 and plan.count("Tcp:") == 1


def test_a_report_takes_its_text_apart_once(spark, tmp_path):
    for day in ("d1", "d2"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "conn.log").write_text("#fields\tts\tid.resp_h\tid.resp_p\tproto\tduration\torig_bytes\tresp_bytes\tconn_state\n1.0\th\t80\ttcp\t-\t1\t2\tSF\n")
    sections = jobs.connection_report(spark, str(tmp_path))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in sections.values() if df.columns != ["day", "server_name"]]
    assert not any("FileScan text" in p for p in plans)
    assert sorted(r.day for r in sections["proto_port"].collect()) == ["d1", "d2"]
