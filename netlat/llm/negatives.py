"""Hard negatives by exact scores, with the method of the four Russians.

Components become integers. A candidate is packed into bit planes: for each bit of its
components and each group of eight dimensions, one byte. Of an anchor all 256 sums
of subsets of each eight dimensions are made beforehand; a plane's score then is a sum
of looked-up sums, and planes are added by shifts, the highest with a minus sign
(two's complement). Candidates stay where they are read; anchors, with their positives
in the second pass, are read by each task in blocks from the shared folder.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlat.llm.common import file_system, qualified
from netlat.session import scratch_path, settle

#: Components are stored as floor(SCALE * x).
SCALE = 256
#: Anchors whose tables are held at a time, candidates scored at a time, and
#: candidates that a task gathers before it reads the anchors.
ANCHORS, SLICE, GATHERED = 256, 1024, 200_000

_PACKED = "row long, id long, label long, anchor boolean, bits int, groups int, planes binary, vector binary"


def planes_of(q: np.ndarray) -> np.ndarray:
    """Bit planes of integer vectors (rows, dimensions): bytes (rows, bits, groups),
    the lowest bit first, the last plane that of the sign."""
    rows, dims = q.shape
    size = q ^ (q >> 63)
    bits = 1 + (int(size.max()).bit_length() if q.size else 0)
    padded = np.zeros((rows, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = q
    shown = (padded[:, None, :] >> np.arange(bits)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(shown.reshape(rows, bits, -1, 8), axis=3, bitorder="little")[..., 0]


def tables_of(q: np.ndarray) -> np.ndarray:
    """Of anchors (rows, dimensions) all sums of subsets: (groups, 256, rows)."""
    rows, dims = q.shape
    padded = np.zeros((rows, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = q
    by_group = padded.reshape(rows, -1, 8).transpose(1, 2, 0)
    # Sums of a plane fit the narrow type if all absolute values together do.
    narrow = not q.size or float(np.abs(q.astype(float)).sum(1).max()) < 2**31 - 1
    out = np.zeros((by_group.shape[0], 256, rows), np.int32 if narrow else np.int64)
    for k in range(8):
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + by_group[:, k, None]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors). Dimensions that one side lacks count as 0."""
    groups = min(tables.shape[0], planes.shape[2])
    total = np.zeros((len(planes), tables.shape[2]), np.int64)
    for b in range(planes.shape[1] - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            if g:
                plane += tables[g].take(planes[:, b, g], 0)  # noqa: F821
            else:
                plane = tables[0].take(planes[:, b, 0], 0)
        if groups:
            total = total - plane if b == planes.shape[1] - 1 else np.add(total, plane, out=total)
    return total


def packed(rows: DataFrame, anchors: Column, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """The rows that take part, with their planes, and the integers of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            values = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            fine = np.ones(batch.num_rows, bool)
            fine[owner[~np.isfinite(values)]] = False
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes[fine]):
                some = np.flatnonzero(fine & (sizes == dims))
                # What is beyond 62 bits is held at the limit.
                q = np.clip(np.floor(SCALE * values[starts[some][:, None] + np.arange(dims)]), -(2.0**62), 2.0**62).astype(np.int64)
                planes = planes_of(q)
                part = batch.take(pa.array(some))
                vector = [v.tobytes() if a else None for v, a in zip(q.astype("<i8"), part.column("anchor").to_pylist(), strict=True)]
                columns = [
                    *(part.column(c) for c in ("row", "id", "label", "anchor")),
                    pa.array(np.full(len(some), planes.shape[1], np.int32)),
                    pa.array(np.full(len(some), planes.shape[2], np.int32)),
                    pa.array([p.tobytes() for p in planes], pa.binary()),
                    pa.array(vector, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "label", "anchor", "bits", "groups", "planes", "vector"])

    wanted = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    return settle(wanted.where("label IS NOT NULL AND vector IS NOT NULL").mapInArrow(run, _PACKED), "bit-planes")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHERED:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _ranked(key: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the first of their key: by score, then identifier."""
    order = np.lexsort((row, id_, -score, key))
    k = key[order]
    nth = np.arange(len(k)) - np.searchsorted(k, k)
    return order[nth < most]


class _Candidates:
    """Some candidates of one width, sorted by label."""

    def __init__(self, table: pa.Table, bits: int, groups: int):
        order = np.argsort(table.column("label").to_numpy(), kind="stable")
        self.label = table.column("label").to_numpy()[order]
        self.row = table.column("row").to_numpy()[order]
        # A null identifier comes last.
        self.id = pc.fill_null(table.column("id"), 2**63 - 1).to_numpy()[order]
        self.null = table.column("id").is_null().to_numpy()[order]
        data = np.frombuffer(b"".join(table.column("planes").to_pylist()), np.uint8)
        self.planes = data.reshape(len(order), bits, groups)[order]

    def of(self, label: int, same: bool) -> Iterator[np.ndarray]:
        a, b = (np.searchsorted(self.label, label, side) for side in ("left", "right"))
        some = np.arange(a, b) if same else np.append(np.arange(a), np.arange(b, len(self.label)))
        for at in range(0, len(some), SLICE):
            yield some[at : at + SLICE]


def _blocks(fs, path: str) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSelector

    for info in fs.get_file_info(FileSelector(path)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=ANCHORS)


def _search(candidates: DataFrame, anchors: str, same: bool, most: int, low: int, high: int) -> DataFrame:
    """anchor, place, id, row, score: of what each task holds the best candidates of each
    anchor: of its label, or for each of its positives (place) of other labels and
    with a score in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(anchors)
        for table in _gathered(batches):
            widths = table.group_by(["bits", "groups"]).aggregate([]).to_pylist()
            groups = [
                _Candidates(table.filter((pc.field("bits") == w["bits"]) & (pc.field("groups") == w["groups"])), w["bits"], w["groups"])
                for w in widths
            ]
            for block in _blocks(fs, folder):
                vectors = [np.frombuffer(v, "<i8") for v in block.column("vector").to_pylist()]
                q = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
                for k, v in enumerate(vectors):
                    q[k, : len(v)] = v
                tables = tables_of(q)
                labels, own = block.column("label").to_numpy(), block.column("row").to_numpy()
                goals = None if same else block.column("positives").to_pylist()
                for label in np.unique(labels):
                    which = np.flatnonzero(labels == label)
                    mine = np.ascontiguousarray(tables[:, :, which])
                    found = [np.zeros(0, np.int64)] * 5
                    for c in groups:
                        for some in c.of(int(label), same):
                            s = scores(mine, c.planes[some])
                            if same:
                                hits = _same(s, c.row[some], own[which], most)
                            else:
                                hits = _other(s, [goals[w] for w in which], low, high)
                            at, a, place, value = hits
                            new = a * 64 + place, value, c.id[some][at], c.row[some][at], c.null[some][at].astype(np.int64)
                            found = [np.append(x, y) for x, y in zip(found, new, strict=True)]
                            kept = _ranked(found[0], *found[1:4], most)
                            found = [x[kept] for x in found]
                    if len(found[0]):
                        columns = [
                            pa.array(own[which][found[0] // 64]),
                            pa.array((found[0] % 64).astype(np.int32)),
                            pa.array(found[2], mask=found[4].astype(bool)),
                            pa.array(found[3]),
                            pa.array(found[1]),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "place", "id", "row", "score"])

    return candidates.drop("vector", "anchor").mapInArrow(run, "anchor long, place int, id long, row long, score long")


def _same(s: np.ndarray, rows: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Candidate, anchor, 0 and score of what may be among the first of a slice."""
    other = rows[:, None] != own[None, :]
    floor = np.full(s.shape[1], np.iinfo(np.int64).min)
    if len(s) > most + 1:
        # The anchor itself may be among the first, so one more is asked for.
        floor = np.partition(s, len(s) - most - 1, 0)[len(s) - most - 1]
    at, a = np.nonzero(other & (s >= floor))
    return at, a, np.zeros(len(at), np.int64), s[at, a]


def _other(s: np.ndarray, goals: list[list[int]], low: int, high: int) -> tuple[np.ndarray, ...]:
    """Candidate, anchor, place of the positive and score where it is in reach."""
    out = []
    for place in range(max(map(len, goals), default=0)):
        has = np.array([place < len(g) for g in goals])
        goal = np.array([g[place] if place < len(g) else 0 for g in goals], np.int64)
        at, a = np.nonzero(has & (low * goal <= 100 * s) & (100 * s <= high * goal))
        out.append((at, a, np.full(len(at), place), s[at, a]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _written(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return qualified(df.sparkSession, path)


def mine(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each
    anchor and each of its positives (the rows of its label with the highest scores, other
    than the anchor itself) the rows of other labels with the highest scores between
    low and high hundredths of the positive's.

    Equal scores go by identifier, a null one last. Rows with a null label or vector, or a
    component that is null or not finite, take no part. Rows that repeat are other rows.
    Vectors of different lengths are filled up with 0; integers beyond 62 bits are held
    there, and sums are those of 64 bits. positives is at most 64. Other columns are
    ignored; an empty table, or one without anchors, gives an empty table.
    """
    held = packed(rows, anchors, id_col, label_col, vector_col)
    chosen = held.where("anchor").select("row", "label", "vector").orderBy("label", "row")
    first = _search(held, _written(chosen, "anchors"), True, positives, low, high)
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    near = first.withColumn("nth", F.row_number().over(order("anchor"))).where(F.col("nth") <= positives)
    near = settle(near.select("anchor", (F.col("nth") - 1).alias("place"), "id", "score"), "positives")

    # An anchor has no more positives than the parameter says.
    goals = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("goals"))
    goals = goals.select(F.col("anchor").alias("row"), F.col("goals.score").alias("positives"))
    with_goals = held.where("anchor").select("row", "label", "vector").join(goals, "row").orderBy("label", "row")
    second = _search(held, _written(with_goals, "anchors-positives"), False, negatives, low, high)
    ranked = second.withColumn("rank", F.row_number().over(order("anchor", "place"))).where(F.col("rank") <= negatives)
    named = held.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    known = near.join(named, "anchor").select("anchor", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    made = ranked.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return made.join(known, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql() -> str:
    """Every anchor against every row in plain SQL, with the relabelling of the query."""
    return f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label = c.label AS same, c.r AS c, c.vec_id AS id,
list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, c) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.id, s.c)::INTEGER AS rank,
s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5"""
