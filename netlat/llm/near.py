"""Near duplicates: ProbMinHash sketches, banding, verification, classes.

Each shingle of a text sends a Poisson process of arrivals, as fast as its weight; an
arrival goes to one of M registers, which keep the shingle that came first. A shingle
is done when its next arrival is later than every register of the text. Registers of
two texts agree as often as their probability Jaccard says.

Links may also be by plain Jaccard, so a text that repeats a shingle has a second
sketch, in which all shingles weigh 1, and its bands too; in other texts both sketches
are the same.

Texts with the same words are one node. Nodes that agree in a band share a bucket; in
a bucket each node is paired with the smallest one only, its bits of the sketches are
compared, and what may be similar is verified on the whole texts. Verified links make
classes. Buckets whose nodes are then all of one class are done; in the others, nodes
of different classes are paired too, so no link in a bucket is lost.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlat.llm.common import free_worker, parts, rows_that_stay, text_of
from netlat.llm.licenses import LOWER_WORDS
from netlat.session import settle

SHINGLE, SIMILAR = 5, 0.8
#: Bytes of texts that are signed together: registers take M * 16 bytes a text.
SIGNED_BYTES = 1_000_000
#: Registers; bands, and registers in a band: half of them. Texts of similarity 0.8
#: agree in no band with a probability of (1 - 0.8^6)^42, about 0.000003.
M, BANDS, ROWS = 512, 42, 6
#: Registers of two sketches, told apart by 4 bits, that differ at most: texts of
#: similarity 0.8 differ in 96 of 512, with a deviation of 8.8, and in more than this
#: with a chance of about one in 100,000.
FAR = 134

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SIGNED = "id long, row_hash long, node long, bits array<long>, plain array<long>, bands array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: str) -> bytes:
    """The words: runs of digits, letters with A-Z in lower case, and what is not ASCII."""
    return b" ".join(text.encode().translate(LOWER_WORDS).split())


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of times, and text of each different shingle of each normal text.
    A text of fewer words has one shingle of them all, one without words has none."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = data != 32
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    word = np.cumsum(np.append(False, ~inside[:-1] & inside[1:]) | (np.arange(len(data)) == starts[0])) - 1
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    powers = np.full(max(int(place[inside].max()) + 1, 1), np.uint64(0x100000001B3))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * powers[np.where(inside, place, 0)], np.uint64(0))
    words = _mix(np.add.reduceat(values, starts))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    counts = np.bincount(owner, minlength=len(texts))
    # Short texts are filled up with an empty word, so that they have one window.
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        ends = np.cumsum(counts)[short]
        fill = size - counts[short]
        words = np.insert(words, np.repeat(ends, fill), np.uint64(0))
        owner = np.insert(owner, np.repeat(ends, fill), np.repeat(short, fill))
    n = len(words) - size + 1
    one = owner[:n] == owner[size - 1 :]
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = _mix(h * _GOLDEN + words[k : n + k])
    h, owner = h[one], owner[:n][one]
    codes, _ = pd.factorize(h ^ _mix(owner.astype(np.uint64) * _GOLDEN))
    first = np.zeros(codes.max() + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return h[first], np.bincount(codes), owner[first]


def _signature(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four bits of each register, plane by plane of 64 registers, and the bands, of sketches."""
    four = (_mix(registers) & np.uint64(15)).astype(np.uint8).reshape(len(registers), registers.shape[1] // 64, 1, 64)
    planes = np.packbits(four >> np.arange(4, dtype=np.uint8)[:, None] & 1, axis=3, bitorder="little")
    bands = np.zeros((len(registers), BANDS), np.uint64)
    for r in range(ROWS):
        bands = _mix(bands * _GOLDEN + registers[:, r : BANDS * ROWS : ROWS])
    return planes.reshape(len(registers), registers.shape[1] // 2).view("<i8"), _mix(bands + np.arange(BANDS, dtype=np.uint64)).view("<i8")


def sketches(h: np.ndarray, times: np.ndarray, owner: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """The registers of each text, m shingles (0 in a text without any). A shingle that
    stands in a text n times weighs 1 + log n. m is a power of two."""
    weight = 1 + np.log(times)
    early = np.full(texts * m, np.inf)
    holder = np.zeros(texts * m, np.uint64)
    last = np.full(texts, np.inf)
    alive, time, step = np.arange(len(h)), np.zeros(len(h)), 0
    while len(alive):
        step += 1
        with np.errstate(over="ignore"):
            draw = _mix(h[alive] + np.uint64(step) * _GOLDEN)
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / weight[alive]
        soon = time < last[owner[alive]]
        alive, time, draw = alive[soon], time[soon], draw[soon]
        at = owner[alive] * m + (draw & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(early, at, time)
        won = early[at] == time
        holder[at[won]] = h[alive[won]]
        last = early.reshape(texts, m).max(1)
    return holder.reshape(texts, m)


def probability_jaccard(a: tuple, b: tuple) -> tuple[float, float]:
    """Of two texts' (hashes, weights), by hash: probability and plain Jaccard."""
    (ha, wa), (hb, wb) = a, b
    every = np.union1d(ha, hb)
    if not len(every):
        return 1.0, 1.0
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ha)] = wa
    y[np.searchsorted(every, hb)] = wb
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(-ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # Shingles with a ratio as large or larger count with their weight in the first
    # text, the others with that in the second.
    upto = np.searchsorted(-ratio, -ratio, "right")
    above, below = np.append(0, np.cumsum(x))[upto], y.sum() - np.append(0, np.cumsum(y))[upto]
    both = (x > 0) & (y > 0)
    weighted = float((1 / (above[both] / x[both] + below[both] / y[both])).sum())
    return weighted, float(both.sum() / len(every))


def sign(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a row: id, row_hash (of the text), node (of its words), bits of the sketch, plain (those
    of the sketch without weights, null if it is the same), bands of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            for part in parts(batch, ["text"], SIGNED_BYTES):
                # Copies in a batch are signed once.
                texts = [normal(t.as_py()) for t in part.column("text")]
                place: dict[bytes, int] = {}
                which = np.array([place.setdefault(t, len(place)) for t in texts], np.int64)
                distinct = list(place)
                nodes = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in distinct), "<i8")
                h, times, owner = shingles(distinct)
                registers = sketches(h, times, owner, len(distinct))
                number = np.bincount(owner, minlength=len(distinct))
                bits, bands = _signature(registers)
                repeats = np.unique(owner[times > 1])
                at = np.full(len(distinct), -1)
                at[repeats] = np.arange(len(repeats))
                some = at[owner] >= 0
                plain, more = _signature(sketches(h[some], np.ones(int(some.sum())), at[owner[some]], len(repeats)))
                own = [np.unique(np.append(bands[t], more[at[t]])) if at[t] >= 0 else bands[t] if number[t] else bands[t][:0] for t in range(len(distinct))]
                lists = [own[w] for w in which]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("row_hash"),
                        pa.array(nodes[which]),
                        pa.array(list(bits[which]), pa.list_(pa.int64())),
                        pa.array([plain[at[w]] if at[w] >= 0 else None for w in which], pa.list_(pa.int64())),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    names=["id", "row_hash", "node", "bits", "plain", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of()).alias("row_hash"), text_of().alias("text"))
    return settle(rows.mapInArrow(run, _SIGNED), "signatures")


#: Columns of a sketch: four bits of each register, a plane of 64 registers each.
WORDS = M // 16


def _spread(nodes: DataFrame) -> DataFrame:
    """Nodes with their sketches as columns s0, s1, .. (with weights) and t0, t1, ..
    (without): Spark compiles a comparison of columns, one of arrays grows too large."""
    plain = F.coalesce("plain", "bits")
    words = [F.get(c, F.lit(k)).alias(f"{name}{k}") for name, c in (("s", F.col("bits")), ("t", plain)) for k in range(WORDS)]
    return nodes.select("node", "bands", "row", F.col("plain").isNotNull().alias("again"), *words)


def _sketch(name: str = "") -> list[Column]:
    """The columns of a sketch, of a table of that alias."""
    at = f"{name}." if name else ""
    return [F.col(f"{at}{c}") for c in ["again", *(f"{s}{k}" for s in "st" for k in range(WORDS))]]


def _differ(a: str, b: str, kind: str) -> Column:
    """In how many registers two sketches differ: the planes of 64 registers are four
    words in a row."""
    total = F.lit(0)
    for k in range(0, WORDS, 4):
        words = [F.col(f"{a}.{kind}{j}").bitwiseXOR(F.col(f"{b}.{kind}{j}")) for j in range(k, k + 4)]
        total = total + F.bit_count(words[0].bitwiseOR(words[1]).bitwiseOR(words[2].bitwiseOR(words[3])))
    return total


def _may_link(a: str, b: str) -> Column:
    """Whether the sketches of two nodes are near enough, those with weights or, where
    a text repeats a shingle, those without."""
    again = F.col(f"{a}.again") | F.col(f"{b}.again")
    return (_differ(a, b, "s") <= FAR) | (again & (_differ(a, b, "t") <= FAR))


def verify(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Of pairs of nodes a, b those whose whole texts (node, text) are similar: in
    probability Jaccard or in plain Jaccard of their shingles."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, ["text_a", "text_b"]):
                place: dict[bytes, int] = {}
                ends = [[place.setdefault(normal(t.as_py()), len(place)) for t in part.column(c)] for c in ("text_a", "text_b")]
                h, times, owner = shingles(list(place))
                order = np.lexsort((h, owner))
                h, w, owner = h[order], 1 + np.log(times[order]), owner[order]
                at = np.searchsorted(owner, np.arange(len(place) + 1))
                of = lambda t: (h[at[t] : at[t + 1]], w[at[t] : at[t + 1]])
                near = [max(probability_jaccard(of(a), of(b))) >= similar for a, b in zip(*ends, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return settle(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node it is linked to over any number of links (a,
    b). Each round takes the smallest root among the neighbours, then the root's root;
    rounds go as the logarithm of the longest path."""
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = settle(ends.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    roots = settle(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")), "roots")
    while True:
        near = edges.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        hooked = roots.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = settle(hooked.join(up, "root").select("node", "before", F.col("up").alias("root")), "roots")
        if new.where("root < before").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def _rooted(nodes: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """nodes with the root of a column's node; nodes without links are their own."""
    other = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return nodes.join(other, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")


def classes(docs: DataFrame, id_col: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """One row a row: the identifier, row_hash, class_id (the smallest identifier of its
    class), class_size, kept (whether it is the row that stays: of the smallest
    identifier, and of rows that share it that of the smallest hash).

    A null text counts as empty; texts without words are one class. A null identifier
    comes after all others. Rows that repeat are in one class, and rows that repeat
    with identifier and text are all marked alike. Other columns are ignored; an
    empty table gives an empty table.
    """
    signed = sign(docs, id_col)
    # A node's row is the same in all its copies, so the first of each task will do.
    each = signed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("bits", "plain", "bands")], F.min(F.struct("id", "row_hash")).alias("row"))
    nodes = settle(_spread(each), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    shared = settle(buckets.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = settle(buckets.join(shared.select("band", "pivot"), "band"), "members")
    star = members.where("node != pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    of = lambda name: nodes.select(F.col("node").alias(name), *_sketch()).alias(f"of_{name}")
    with_a = star.alias("p").join(of("a"), F.col("p.a") == F.col("of_a.a")).select("p.*", *_sketch("of_a")).alias("x")
    near = (F.col("x.b") == F.col("of_b.b")) & _may_link("x", "of_b")
    star = settle(with_a.join(of("b"), near).select("x.a", "x.b", "x.n"), "pairs")

    # Whole texts of the nodes that may have a link, of one row each.
    wanted = members.select("node").distinct().join(nodes.select("node", "row"), "node").select("node", F.col("row.id").alias("_id"), F.col("row.row_hash").alias("_hash"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of().alias("text")).withColumn("_hash", F.xxhash64("text"))
    key = lambda df: df.withColumn("_id", F.coalesce("_id", F.lit(-(2**63))))
    texts = settle(key(rows).join(key(wanted), ["_id", "_hash"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    # First each node with the pivot it shares most bands with, then the other pivots
    # that are of another class still.
    best = star.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    links = verify(best.select("a", "b"), texts, similar)
    roots = components(links)
    apart = _rooted(_rooted(star.join(best, ["a", "b"], "left_anti"), roots, "a", "root_a"), roots, "b", "root_b").where("root_a != root_b")
    links = settle(links.unionByName(verify(apart.select("a", "b"), texts, similar)), "links")
    roots = components(links)

    # Buckets that hold more than one class: all pairs of different classes whose
    # sketches are near, but those that were tried.
    rooted = _rooted(members, roots, "node", "root")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    some = settle(rooted.join(mixed, "band").join(nodes.select("node", "bands", *_sketch()), "node").select("band", "node", "root", "bands", *_sketch()), "mixed")
    a, b = some.alias("x"), some.alias("y")
    # A pair that shares several buckets is made in one of them.
    here = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")
    near = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y") & here
    pairs = a.join(b, (F.col("x.band") == F.col("y.band")) & near)
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).join(star, ["a", "b"], "left_anti")
    links = settle(links.unionByName(verify(pairs, texts, similar)), "links")
    roots = components(links)

    grouped = _rooted(signed.select("id", "row_hash", "node"), roots, "node", "root")
    order = F.struct(F.col("id").isNull().alias("late"), "id", "row_hash")
    whole = grouped.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    judged = grouped.join(whole, "root").select(
        F.col("id").alias(id_col),
        "row_hash",
        F.col("first.id").alias("class_id"),
        "class_size",
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row_hash") == F.col("first.row_hash"))).alias("kept"),
    )
    return judged


def dedup(docs: DataFrame, id_col: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """One document of each class, with its columns as they were."""
    stay = classes(docs, id_col, similar).where("kept").select(F.col(id_col).alias("id"), F.col("row_hash").alias("mark"))
    return rows_that_stay(docs, stay, F.xxhash64(text_of()), id_col, once=True)
