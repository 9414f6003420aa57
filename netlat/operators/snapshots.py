"""Snapshot values from the raw text that a host's tools print."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlat.functions.text import int_sum, kv, once, words
from netlat.operators.sections import states

# States whose queues count, and places in the counter lines.
QUEUE_STATES = ["ESTAB", "LISTEN", "TIME-WAIT", "CLOSE-WAIT"]
TCP_PLACES = {"snmp_ActiveOpens": 5, "snmp_PassiveOpens": 6, "snmp_AttemptFails": 7, "snmp_RetransSegs": 12}
DROPS_PLACE = 21


def _lines(c: str) -> Column:
    return F.split(F.coalesce(F.col(c), F.lit("")), "\n")


def _zero(c: Column, kind: str = "bigint") -> Column:
    return F.coalesce(c, F.lit(0)).cast(kind)


def _counters(c: str, start: str, need: int) -> Column:
    """Words of the last line of counters: it begins so, has more than `need` words and
    a number as its second; the line of names above it has none."""
    rows = F.transform(F.filter(_lines(c), lambda x: x.startswith(start)), lambda x: words(x))
    return F.try_element_at(F.filter(rows, lambda w: (F.size(w) > need) & w[1].rlike(r"^\d+$")), F.lit(-1))


def _starts_with_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda test, part: test | c.startswith(part), parts, F.lit(False))


def _interrupts(name: str, other: str | None = None) -> Column:
    """Sum over the processors in the last line of a kind."""
    lines = F.filter(_lines("softirqs"), lambda x: x.contains(name) & (~x.contains(other) if other else F.lit(True)))
    # Without such a line the sum is null.
    return _zero(int_sum(F.try_element_at(lines, F.lit(-1)), whole_tokens=True))


def socket_values(df: DataFrame, text: str = "sockets") -> DataFrame:
    """df with sum and number of round trips, longest queues and smallest windows of a
    socket list with details; its first line is a heading. 0 where there is none."""
    first = F.coalesce(F.instr(F.col(text), "\n"), F.lit(0))
    df = once(df, {"_body": F.when(first > 0, F.substring(F.col(text), first + 1, F.length(text))).otherwise("")})
    # Only a line that begins with one of the states can be one of its rows.
    queued = lambda x: _starts_with_any(F.btrim(x, F.lit(" \t\r\n")), QUEUE_STATES)
    rows = F.transform(F.filter(F.split("_body", "\n"), queued), lambda x: words(x))
    queues = F.filter(rows, lambda w: (F.size(w) >= 5) & w[0].isin(QUEUE_STATES))
    of = lambda i: F.array_max(F.transform("_queues", lambda w: F.when(w[i].rlike(r"^\d+$"), w[i].try_cast("bigint"))))
    trips = kv("_body", "rtt", all=True, number=r"[\d.]+", lead=r"\s", type="double")
    smallest = lambda key: F.array_min(kv("_body", key, all=True))
    made = once(df, {"_queues": queues, "_trips": trips}).withColumns(
        {
            "tcp_rtt_sum": F.aggregate("_trips", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))),
            "tcp_rtt_count": F.size(F.filter("_trips", F.isnotnull)).cast("bigint"),
            "tcp_recv_q_max": _zero(of(1)),
            "tcp_send_q_max": _zero(of(2)),
            "tcp_cwnd_min": _zero(smallest("cwnd")),
            "tcp_ssthresh_min": _zero(smallest("ssthresh")),
        }
    )
    return made.drop("_body", "_queues", "_trips")


def text_values(df: DataFrame) -> DataFrame:
    """Snapshot columns from the texts of df: sockets, snmp, netstat and softirqs, whose
    place they take. Missing or unreadable parts are 0."""
    counters = {"_tcp": _counters("snmp", "Tcp:", 12), "_drops": _counters("netstat", "TcpExt:", DROPS_PLACE)}
    at = lambda w, i: _zero(F.try_element_at(w, F.lit(i + 1)).try_cast("bigint"))
    made = once(socket_values(df), counters).withColumns(
        {
            **{name: at("_tcp", i) for name, i in TCP_PLACES.items()},
            "snmp_ListenDrops": at("_drops", DROPS_PLACE),
            "softirq_net_rx": _interrupts("NET_RX"),
            "softirq_net_tx": _interrupts("NET_TX", "NET_RX"),
        }
    )
    return made.drop("sockets", "snmp", "netstat", "softirqs", "_tcp", "_drops")


def socket_rows(df: DataFrame, keep: list[str] = QUEUE_STATES, text: str = "sockets") -> DataFrame:
    """One row per socket in one of the states: the other columns, state, recv_q, send_q."""
    line = F.explode(F.slice(_lines(text), F.lit(2), F.greatest(F.size(_lines(text)) - 1, F.lit(0)))).alias("_line")
    rows = df.select(*[c for c in df.columns if c != text], line).withColumn("_w", words("_line"))
    rows = rows.where(F.size("_w") >= 5).select("*", F.col("_w")[0].alias("state"))
    number = lambda i: F.col("_w")[i].try_cast("bigint")
    return states(rows, keep).withColumns({"recv_q": number(1), "send_q": number(2)}).drop("_line", "_w")
