"""Ranked lexical search: many queries at once, with what they share computed once.

Queries come in blocks of a bounded size. For a block, pairs of terms that several
queries hold are mined, most frequent first, and pairs of such pairs again: each
shared set is a node of a graph in which queries meet. One reading of the documents
counts the block's terms; documents then are scored some at a time: each node's
partial accumulator is made once from two others, and a query is the sum of its
few nodes and of the terms that it shares with none. Each task keeps the best of
its documents by query, and the best of all come from those.
"""

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlat.llm.common import text_of
from netlat.llm.licenses import LOWER_WORDS
from netlat.session import settle

#: Queries, and different terms of each summed up, of a block.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 200_000
#: Terms of a query among which pairs are mined at once; the result does not depend on it.
MINED = 256
#: Bytes of accumulators held at a time.
HELD = 48_000_000
#: Bytes of a text that are cut into words at a time.
CHUNK = 4_000_000

_POSTINGS = "id long, n long, terms binary, times binary"
_BEST = "item int, id long, score long"


def words(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, some at a time: runs of digits, letters with A-Z in
    lower case, and what is not ASCII."""
    data = (text or "").encode().translate(LOWER_WORDS)
    at = 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def sharing(queries: list[list[int]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(nodes, parts): queries as sets of symbols 0 to n - 1, of which node k is symbol
    n + k, the union of two earlier ones. parts has for each query the symbols whose
    sum it is. A node is made while two queries at least still hold both its halves."""
    n = 1 + max((s for q in queries for s in q), default=-1)
    often = Counter(s for q in queries for s in q)
    held = [set(q) for q in queries]
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    # Only what several queries have can be shared. Long queries are mined by runs of
    # terms that are about as frequent.
    run: list[dict[int, int]] = []
    for k, q in enumerate(queries):
        some = sorted((s for s in set(q) if often[s] > 1), key=lambda s: (-often[s], s))
        run.append({s: i // MINED for i, s in enumerate(some)})
        for at in range(0, len(some), MINED):
            part = sorted(some[at : at + MINED])
            for i, a in enumerate(part):
                for b in part[i + 1 :]:
                    holders[a, b].add(k)
    holders = defaultdict(set, {p: h for p, h in holders.items() if len(h) > 1})
    heap = [(-len(h), p) for p, h in holders.items()]
    heapq.heapify(heap)
    nodes: list[tuple[int, int]] = []
    while heap:
        claimed, pair = heapq.heappop(heap)
        a, b = pair
        having = {k for k in holders.get(pair, ()) if a in held[k] and b in held[k]}
        if len(having) < 2:
            continue
        if len(having) < -claimed:
            holders[pair] = having
            heapq.heappush(heap, (-len(having), pair))
            continue
        new = n + len(nodes)
        nodes.append(pair)
        del holders[pair]
        beside: Counter = Counter()
        for k in having:
            held[k] -= {a, b}
            place = run[k].pop(a)
            run[k].pop(b)
            for s, p in run[k].items():
                if p == place:
                    holders[s, new].add(k)
                    beside[s] += 1
            run[k][new] = place
            held[k].add(new)
        for s, m in beside.items():
            if m > 1:
                heapq.heappush(heap, (-m, (s, new)))
            else:
                del holders[s, new]
    return nodes, [sorted(h) for h in held]


class Block:
    """Queries with their vocabulary and the graph in which they meet."""

    def __init__(self, counted: list[tuple[int, Counter]]):
        self.items = [i for i, _ in counted]
        self.words = sorted({w for _, c in counted for w in c})
        place = {w: k for k, w in enumerate(self.words)}
        # A term that a query repeats is another symbol than the term once.
        symbols: dict[tuple[int, int], int] = {}
        queries = [[symbols.setdefault((place[w], k), len(symbols)) for w, k in sorted(c.items())] for _, c in counted]
        self.symbols = np.array(list(symbols), np.int64).reshape(-1, 2)
        self.nodes, self.parts = sharing(queries)


def blocks(items: DataFrame, id_col: str = "item_id") -> Iterator[tuple[list, Block]]:
    """Identifiers and the block of some queries at a time. A query with very many
    terms is a block of its own."""
    ids, counted, terms = [], [], 0
    for row in items.select(F.col(id_col).cast("long").alias("id"), text_of().alias("text")).toLocalIterator():
        bag: Counter = Counter()
        for some in words(row["text"]):
            bag.update(some)
        if not bag:
            continue
        if ids and (len(ids) >= BLOCK_ITEMS or terms + len(bag) > BLOCK_TERMS):
            yield ids, Block(counted)
            ids, counted, terms = [], [], 0
        counted.append((len(ids), bag))
        ids.append(row["id"])
        terms += len(bag)
    if ids:
        yield ids, Block(counted)


def postings(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id") -> DataFrame:
    """id, n (all terms of the text) and which of a list of terms it has how often;
    written to the shared folder."""
    place = {w: k for k, w in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, times = [], [], []
            for text in batch.column("text"):
                n, hits = 0, []
                for some in words(text.as_py()):
                    n += len(some)
                    hits += [k for k in map(place.get, some) if k is not None]
                counted = Counter(hits)
                sizes.append(n)
                found.append(np.fromiter(counted.keys(), "<u4", len(counted)).tobytes())
                times.append(np.fromiter(counted.values(), "<u4", len(counted)).tobytes())
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of().alias("text"))
    return settle(rows.mapInArrow(run, _POSTINGS).where("n > 0"), "postings")


def document_counts(held: DataFrame, n: int) -> np.ndarray:
    """In how many documents each of n terms stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, np.int64)
        for batch in batches:
            for terms in batch.column("terms"):
                counts[np.frombuffer(terms.as_buffer(), "<u4")] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "n"])

    summed = held.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(n, np.int64)
    for term, count in summed.collect():  # at most as many rows as the block has terms
        out[term] = count
    return out


def accumulate(block: Block, shares: np.ndarray, doc: np.ndarray, symbol: np.ndarray, docs: int) -> Iterator[np.ndarray]:
    """The scores of some documents, a query after the other. doc, symbol and shares:
    what each symbol adds to the score of a document that has it."""
    n = len(block.symbols)
    held = np.zeros((n + len(block.nodes), docs), np.int64)
    held[symbol, doc] = shares
    for k, (a, b) in enumerate(block.nodes):
        np.add(held[a], held[b], out=held[n + k])
    for part in block.parts:
        yield held[part].sum(0)


def best(held: DataFrame, block: Block, found: np.ndarray, documents: int, length: int, most: int) -> DataFrame:
    """item (its place in the block), id, score of the best documents of each task."""
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in found], np.int64)
    # The symbols of each term, next to each other.
    order = np.argsort(block.symbols[:, 0], kind="stable")
    starts = np.searchsorted(block.symbols[order, 0], np.arange(len(found) + 1))
    rows_at_once = max(64, min(4096, HELD // (8 * (len(block.symbols) + len(block.nodes) + 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in block.parts]
        floor = [1] * len(top)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                lists = [np.frombuffer(t.as_buffer(), "<u4") for t in part.column("terms")]
                term = np.concatenate(lists).astype(np.int64)
                tf = np.concatenate([np.frombuffer(t.as_buffer(), "<u4") for t in part.column("times")]).astype(np.int64)
                doc = np.repeat(np.arange(len(lists)), list(map(len, lists)))
                m = 100 - 25 + 25 * part.column("n").to_numpy() * documents // length
                share = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                # A term counts for each of its symbols, as often as the symbol repeats it.
                many = starts[term + 1] - starts[term]
                which = np.repeat(np.arange(len(term)), many)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                symbol = order[starts[term[which]] + nth]
                shares = share[which] * block.symbols[symbol, 1]
                none = part.column("id").is_null().to_numpy(zero_copy_only=False)
                ids = part.column("id").fill_null(0).to_numpy()
                for k, scores in enumerate(accumulate(block, shares, doc[which], symbol, len(lists))):
                    more = np.flatnonzero(scores >= floor[k])
                    if not len(more):
                        continue
                    s, i, e = (np.append(a, b[more]) for a, b in zip(top[k], (scores, ids, none), strict=True))
                    kept = np.lexsort((i, e, -s))[:most]
                    top[k] = s[kept], i[kept], e[kept]
                    if len(kept) == most:
                        floor[k] = max(1, int(s[kept[-1]]))
        sizes = [len(t[0]) for t in top]
        scores, ids, none = (np.concatenate([t[c] for t in top]) for c in range(3))
        items = np.repeat(np.arange(len(top), dtype=np.int32), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids, mask=none), pa.array(scores)], names=["item", "id", "score"])

    return held.where("octet_length(terms) > 0").mapInArrow(run, _BEST)


def search(docs: DataFrame, items: DataFrame, most: int = 20, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the most documents with the highest
    scores above 0, equal scores by identifier, a null one last.

    A null or empty text has no terms: such a document is not counted, such an item has
    no rows. Items that repeat are searched each, documents that repeat are ranked each.
    Other columns are ignored; an empty table on either side gives an empty table.
    """
    spark, out = docs.sparkSession, None
    for ids, block in blocks(items, item_col):
        held = postings(docs, block.words, id_col)
        documents, length = held.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        made = best(held, block, document_counts(held, len(block.words)), documents, length, most)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")  # a block's items
        rows = ranked.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def sql(most: int = 20) -> str:
    """The same in plain SQL, every term of every item against every document."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
q AS (SELECT i, item_id, term, count(*) AS k
FROM (SELECT row_number() OVER () AS i, item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
x AS (SELECT i, item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))))::BIGINT AS score
FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY i, item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY rank <= {most}"""
