"""Packing documents into training sequences by patterns.

The plan is made on the histogram of lengths alone, which has no more rows than a
sequence has tokens: patterns of a few lengths that fill a sequence are enumerated,
non-negative least squares fits how often each is used to the histogram, the counts
are rounded, and what they leave is packed best fit, longest first, still by
length. Documents then find their place by their number among those of their length.

The number of patterns is limited (FEW, GRID, HEADS, MOST), not what is packed: lengths
that no pattern holds go to the best fit. Several plans are made, from all patterns to
none of them, and the one with the fewest sequences is taken, so a plan is never worse
than best fit alone.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlat.llm.common import text_of
from netlat.llm.pieces import Encoder, encoder
from netlat.session import scratch_path

#: Documents a pattern holds at most.
FEW = 6
#: Lengths that stand for all when patterns of three and more are enumerated.
GRID = 40
#: Beginnings of patterns that are carried on at each number of documents, and patterns
#: that are fitted: with more, every n-th beginning, and of each longest length those
#: that leave least empty.
HEADS, MOST = 30_000, 16_000
#: The fit ends when a step changes the counts by less than this share, or after so many.
CHANGE, STEPS = 1e-3, 400

#: Weight of what is left empty, against that of the counts.
EMPTY = 4.0

#: Bytes of pieces a worker keeps; other stages run in the same workers later.
KEPT = 70_000_000

_PIECES = "chunk int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id") -> DataFrame:
    """The ids of each whole text and the end id, in pieces of at most size; written
    to the shared folder. chunk, length and nth (the row's number among those of its
    length in its chunk) name a row, also where identifiers repeat or are null."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, seen = encoder(tokenizer, _frugal), int(end_id).to_bytes(4, "little"), np.zeros(size + 1, np.int64)
        chunk = TaskContext.get().partitionId()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = coder.one(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    n = len(part) // 4
                    rows.append((chunk, int(seen[n]), doc_id, piece, at // 4, n, zlib.crc32(part), part))
                    seen[n] += 1
                    held += n
                if held > 2_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of().alias("text"))
    path = scratch_path(spark, "pieces")
    rows.mapInArrow(run, _PIECES).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_PIECES).parquet(path)


def _frugal(path: str) -> Encoder:
    return Encoder(path, KEPT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["chunk", "nth", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def patterns(counts: np.ndarray, size: int, few: int = FEW, grid: int = GRID, most: int = MOST) -> np.ndarray:
    """Rows of up to few lengths, longest first and padded with 0, that fill a
    sequence as well as the lengths there are allow."""
    there = np.flatnonzero(counts)
    if not len(there):
        return np.zeros((0, few), np.int64)
    # The longest length there is that fits into each space.
    fit = np.zeros(size + 1, np.int64)
    fit[there] = there
    fit = np.maximum.accumulate(fit)
    weight = np.cumsum(counts[there] * np.sqrt(there))
    some = np.unique(there[np.searchsorted(weight, np.linspace(0, weight[-1], grid + 2)[1:-1])])
    out = []
    # Each set of lengths from the grid, up to few - 2 of them, next to each length;
    # the last place goes to what fits best.
    heads = [there[:, None]]
    for k in range(few - 1):
        head = heads[-1]
        space = size - head.sum(1)
        last = fit[space]
        full = np.concatenate([head, last[:, None]], 1)
        out.append(np.pad(full, ((0, 0), (0, few - full.shape[1]))))
        if k == few - 2:
            break
        pool = some if k < 2 else some[:: 2 ** (k - 1)]
        a = np.repeat(head, len(pool), 0)
        b = np.tile(pool, len(head))
        ok = (a.sum(1) + b <= size) & ((b <= a[:, -1]) | (k == 0))
        grown = np.concatenate([a[ok], b[ok][:, None]], 1)
        heads.append(grown[:: max(1, -(-len(grown) // HEADS))])
    rows = np.unique(-np.sort(-np.concatenate(out), 1), axis=0)
    rows = rows[rows.sum(1) <= size]
    # Of each longest length first the patterns that leave least empty, so that every
    # length has some when their number is cut.
    rows = rows[np.lexsort((size - rows.sum(1), rows[:, 0]))]
    nth = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.argsort(nth, kind="stable")][:most]


def fit_counts(rows: np.ndarray, counts: np.ndarray, size: int, steps: int = STEPS) -> np.ndarray:
    """How often each pattern is used: non-negative least squares against the
    histogram and against nothing left empty, by accelerated projected gradients. Each
    length is weighed by its count, so rare lengths are fitted as well as frequent ones."""
    used = rows > 0
    scale = np.zeros(len(counts) + 1)
    scale[:-1][counts > 0] = 1 / np.sqrt(counts[counts > 0])
    empty = (size - rows.sum(1)) / size
    scale[-1] = EMPTY / np.sqrt(counts.sum())
    goal = np.append(np.sqrt(counts.astype(float)), 0)
    apply = lambda x: np.append(np.bincount(rows.ravel(), (used * x[:, None]).ravel(), len(counts)), empty @ x) * scale
    back = lambda r: ((r * scale)[:-1][rows] * used).sum(1) + r[-1] * scale[-1] * empty
    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(apply(y) - goal) / (1.05 * norm))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        done = np.linalg.norm(new - x) <= CHANGE * np.linalg.norm(new)
        x, t = new, after
        if done:
            break
    return x


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of counts by length: sequences of the same contents
    are one entry with their number."""
    by_space: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces = np.zeros(size + 1, bool)

    def put(space: int, held: tuple[int, ...], n: int) -> None:
        by_space.setdefault(space, []).append((held, n))
        spaces[space] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            tight = np.flatnonzero(spaces[length:])
            if len(tight):
                space = length + int(tight[0])
                held, bins = by_space[space].pop()
                if not by_space[space]:
                    spaces[space] = False
            else:
                space, held, bins = size, (), n
            # The tightest sequence is filled until the length fits no more.
            each = space // length
            whole = min(bins, n // each)
            if whole:
                put(space - each * length, held + (length,) * each, whole)
                n -= whole * each
            elif n:
                put(space - n * length, held + (length,) * n, 1)
                whole, n = 1, 0
            if bins > whole and held:
                put(space, held, bins - whole)
    return [(held, n) for groups in by_space.values() for held, n in groups]


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences, longest length first, each with how many sequences have
    them; every length is used as often as counts says."""
    left = counts.astype(np.int64).copy()
    whole = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    rows = patterns(left, size)
    made = []
    if len(rows):
        fitted = fit_counts(rows, left, size)
        # A least-squares fit needs no more patterns than there are lengths: halve to
        # the most used and fit again, so counts are not spread too thin to round.
        while len(rows) > np.count_nonzero(left):
            rows = rows[np.sort(np.argsort(-fitted, kind="stable")[: max(len(rows) // 2, np.count_nonzero(left))])]
            fitted = fit_counts(rows, left, size)
        # What patterns that leave more than a share empty would hold is left to the
        # best fit; a smaller share takes more patterns back.
        empty = size - rows.sum(1)
        for share in (size // 100, size // 400, 0):
            made.append(_with_patterns(rows, np.where(empty <= share, np.rint(fitted), 0).astype(np.int64), left, size))
    made.append(_with_patterns(rows[:0], np.zeros(0, np.int64), left, size))
    return whole + min(made, key=lambda m: sum(n for _, n in m))


def _with_patterns(rows: np.ndarray, times: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as wanted and as the lengths allow, and best fit for the rest."""
    left, out = counts.copy(), []
    for k in np.argsort(-times, kind="stable"):
        if not times[k]:
            break
        lengths, each = np.unique(rows[k][rows[k] > 0], return_counts=True)
        n = int(min(times[k], (left[lengths] // each).min()))
        if n:
            left[lengths] -= n * each
            out.append((tuple(rows[k][rows[k] > 0].tolist()), n))
    return out + [(tuple(sorted(held, reverse=True)), n) for held, n in best_fit(left, size)]


def places(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Where the documents of each length go, in the order of their numbers: rows of
    length, first number, times in a sequence, first sequence, first offset."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for held, n in made:
        offset = 0
        for length, times in zip(*(a.tolist() for a in np.unique(held, return_counts=True)), strict=True):
            out.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * times
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def assign(pieces: DataFrame, size: int) -> DataFrame:
    """pieces (of cut_pieces, without their ids) with sequence_id and offset."""
    rows = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # one row a length
    counts = np.zeros(size + 1, np.int64)
    for r in rows:
        counts[r["length"]] = r["n"]
    table = places(plan(counts, size))
    keys = table[:, 0] << 44 | table[:, 1]

    # Rows of a length before those of a chunk: one row a chunk and length.
    chunks = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = pieces.drop("ids").join(chunks, ["length", "chunk"]).withColumn("number", F.col("before") + F.col("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = table[np.searchsorted(keys, length << 44 | number, "right") - 1]
            nth, times = number - at[:, 1], at[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in out), pa.array(at[:, 3] + nth // times), pa.array(at[:, 4] + nth % times * length)],
                names=[*out, "sequence_id", "offset"],
            )

    out = ["chunk", "nth", "doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = _PIECES.removesuffix(", ids binary") + ", sequence_id long, offset long"
    return numbered.select(*out, "number").mapInArrow(run, kinds)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, the same rows with sequence_id and offset instead).

    A null text is the end id alone; rows that repeat are packed each; an empty table
    gives empty tables. Other columns are ignored.
    """
    pieces = cut_pieces(docs, tokenizer, end_id, size, id_col)
    return pieces, assign(pieces, size)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id and ids (little-endian unsigned 32-bit integers) of each sequence."""
    key = ["chunk", "length", "nth"]
    rows = placed.select(*key, "sequence_id", "offset").join(pieces.select(*key, "ids"), key)
    # A sequence has at most as many pieces as it has tokens.
    held = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return held.select("sequence_id", F.aggregate("held.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
