"""Quality rules kept as bits.

Every rule is evaluated once for each document; the ledger holds the measurements and
one integer whose bit k says that rule k failed. A policy is a mask with a version:
applying one, or finding what each of its rules alone rejects, works on the bits.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from netlat.llm.common import text_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks")
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))

#: Name and condition of failure, in the order of the bits; new rules go to the end.
#: The conditions mean the same in Spark and in plain SQL.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("upper_case", "n_upper > n_lower"),
    ("exclamations", "2 * n_marks > n_words"),
    ("many_words", "n_words > 10000000"),
)
BASE = ("few_words", "repeated_words")
#: Rules that each version of the policy holds documents to.
POLICIES = {
    1: (*BASE, "symbols"),
    2: (*BASE, "symbols", "repeated_lines", "word_length", "upper_case", "exclamations"),
}
CURRENT = 2


def mask(names: tuple[str, ...]) -> int:
    order = [name for name, _ in RULES]
    return sum(1 << order.index(n) for n in set(names))


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words that stand in a window of n words which the text has twice or more."""
    if len(words) <= n:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    keys = ids[: len(ids) - n + 1]
    for k in range(1, n):
        # Window numbers are made small again at each step, so no product overflows.
        keys = np.unique(keys * len(numbers) + ids[k : len(ids) - n + 1 + k], return_inverse=True)[1]
    twice = np.bincount(keys)[keys] > 1
    covered = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements in the order of MEASURES."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    count = lambda chars: len(data) - len(data.translate(None, chars))
    return (
        len(words),
        len(text) - count(b" \t\n\r\x0b\x0c"),
        count(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        count(_UPPER),
        count(_LOWER),
        count(b"!"),
    )


#: The columns in which measured() adds the measurements and the bits to a table.
ENTRY, FAILED = "_netlat_ledger", "_netlat_failed"


def measured(docs: DataFrame) -> DataFrame:
    """docs with the ledger's entry of each row as two more columns: the measurements, a
    struct, and the bits of the rules that it fails. Each rule is evaluated once."""
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t.as_py() or "") for t in batch.column("text")], np.int64).reshape(-1, len(MEASURES))
            entry = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(MEASURES))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, entry], names=[*batch.schema.names, ENTRY])

    entry = StructType([StructField(m, LongType()) for m in MEASURES])
    rows = docs.withColumn("text", F.col("text").cast("string"))
    made = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(ENTRY, entry)]))
    failed = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(RULES):
        for m in sorted(MEASURES, key=len, reverse=True):
            fails = re.sub(rf"\b{m}\b", f"{ENTRY}.{m}", fails)
        failed = failed.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(0).cast("long"))
    return made.withColumn(FAILED, failed)


def ledger(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a row: the identifier, the measurements and failed, the bits.

    Words are runs of other than ASCII white space. A null text has no words and
    fails what an empty one fails. Rows that repeat are measured each. Other columns are
    ignored; an empty table gives an empty table.
    """
    rows = measured(docs.select(F.col(id_col).cast("long").alias("id"), text_of().alias("text")))
    return rows.select(F.col("id").alias(id_col), f"{ENTRY}.*", F.col(FAILED).alias("failed"))


def _holds(failed: str, names) -> Column:
    """Whether any of some rules is among the bits."""
    return F.col(failed).bitwiseAND(F.lit(mask(names)).cast("long")) != 0


def keep(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The documents that pass a policy, with their columns as they were: the ledger's bits
    under the policy's mask. Rows are judged where they are read, so nothing is shuffled.

    A null or empty text fails, having too few words; rows that repeat are judged alike
    and all stay or go; other columns may have any names but the two of the ledger; an
    empty table gives an empty table.
    """
    return measured(docs).where(~_holds(FAILED, (*BASE, *POLICIES[version]))).select(*(F.col(f"`{c}`") for c in docs.columns))


def apply_policy(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with policy (its version), base_failed and kept."""
    held = lambda names: _holds("failed", names)
    return entries.withColumns({"policy": F.lit(version), "base_failed": held(BASE), "kept": ~held((*BASE, *POLICIES[version]))})


def ablations(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: rejected (documents that fail it), alone (those that
    fail no other rule of the policy, so leaving it out would keep them). Documents
    are first counted by their bits, of which there are few."""
    names = POLICIES[version]
    order = [name for name, _ in RULES]
    counted = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(names)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << order.index(n)).cast("long").alias("bit")) for n in names])
    rows = counted.select("bits", "n", F.explode(each).alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("alone"),
    )


def sql(version: int = CURRENT) -> str:
    """The ledger and the policy in plain SQL."""
    word = r"'[^\x20\x09-\x0D]+'"
    tests = dict(RULES)
    count = lambda kind: f"length(regexp_replace(t, '[^{kind}]', '', 'g'))"
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(RULES))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, {word}) AS w FROM d),
g AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS o(o) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, {word}) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
{count("#*$%&|<>")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
coalesce(n_lines, 0) AS n_lines, {count("A-Z")} AS n_upper, {count("a-z")} AS n_lower, {count("!")} AS n_marks
FROM d JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_lower, n_marks,
({bits})::BIGINT AS failed, {version} AS policy, {" OR ".join(f"({tests[n]})" for n in BASE)} AS base_failed,
NOT ({" OR ".join(f"({tests[n]})" for n in POLICIES[version])}) AS kept FROM m"""
