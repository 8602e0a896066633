"""Exact ranked lexical search by a dual tree over items and documents.

A document is a vector with one coordinate per term, its impact: how often the
term occurs, damped by the document's length. An item is a vector of its terms'
weights, counted as often as they occur. The score is their inner product, in
whole numbers. Both sides stand in trees whose nodes hold the maximum of every
coordinate below them, so the inner product of two nodes bounds every score
between their batches. A pair of nodes is given up when its bound is below the
weakest kth score among the items of the one, else both are opened, down to
batches of documents that are scored exactly.

Items come in groups of bounded text, whose vocabulary every task holds; each
group reads the documents' texts once and keeps the coordinates that its items
have, as a narrow table. Document trees stand over blocks of bounded size inside a
task, sorted so that like documents share a batch. Weakest scores start from those
of a sample of documents, which are true scores and so can only prune what is
beaten. A task gives at most ``k`` documents per item to the last ranking.

Null texts have no terms and count nowhere. Ids are integers; a null id is ranked
after all others of the same score. Repeated rows are documents of their own, and
so are rows of one id. Items are ranked row by row; equal rows once. An empty table
on either side gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.plans.scratch import durable

#: Items' bytes per group; a group's terms are what a task holds and what is broadcast.
GROUP_BYTES = 8 << 20
LEAF = 64
FANOUT = 8
BLOCK_ROWS = 8192
BLOCK_TERMS = 2_000_000
SEEDS = 32
HELD = 60_000

# Terms are runs of these bytes; A-Z is lowered, all other bytes part them.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after the other."""
    sizes = ends - starts
    if not sizes.sum():
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


@dataclass
class Sparse:
    """Rows of (column, value), ``ends[i]`` to ``ends[i + 1]``; columns ascend in a row."""

    ends: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.ends) - 1

    def maxima(self, group: int, width: int) -> Sparse:
        """Rows of the maximum per column over every ``group`` consecutive rows."""
        above = -(-self.rows // group)
        if not len(self.columns):
            return Sparse(np.zeros(above + 1, np.int64), self.columns, self.values)
        row = np.repeat(np.arange(self.rows) // group, np.diff(self.ends))
        keys = row * width + self.columns
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.searchsorted(keys[first], np.arange(above + 1) * width)
        return Sparse(ends, keys[first] % width, np.maximum.reduceat(self.values[order], first))

    def products(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner products of some rows with a dense vector."""
        starts, ends = self.ends[rows], self.ends[rows + 1]
        at = _spans(starts, ends)
        sums = np.concatenate([[0], np.cumsum(self.values[at] * dense[self.columns[at]])])
        cut = np.concatenate([[0], np.cumsum(ends - starts)])
        return sums[cut[1:]] - sums[cut[:-1]]

    def turned(self, width: int) -> Sparse:
        """Columns as rows."""
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(self.rows), np.diff(self.ends))
        return Sparse(np.searchsorted(self.columns[order], np.arange(width + 1)), row[order], self.values[order])


class ItemTree:
    """Items in order of their heaviest terms, with maxima over every ``FANOUT`` nodes of the level below."""

    def __init__(self, items: list[dict[int, int]], weights: np.ndarray):
        valued = [sorted((t, int(n * weights[t])) for t, n in item.items() if weights[t] > 0) for item in items]
        #: Place in the tree to number of the item.
        self.order = np.array(sorted(range(len(items)), key=lambda i: sorted((-v, t) for t, v in valued[i])[:4]), np.int64)
        self.width = len(weights)
        flat = [entry for i in self.order for entry in valued[i]]
        ends = np.concatenate([[0], np.cumsum([len(valued[i]) for i in self.order])]).astype(np.int64)
        base = Sparse(ends, np.array([t for t, _ in flat], np.int64), np.array([v for _, v in flat], np.int64))
        self.levels = [base]
        while self.levels[-1].rows > FANOUT:
            self.levels.append(self.levels[-1].maxima(FANOUT, self.width))
        self.by_term = base.turned(self.width)


class Search:
    """The best ``k`` documents per item among those shown to it."""

    def __init__(self, tree: ItemTree, k: int, floors: np.ndarray):
        self.tree, self.k = tree, k
        self.weakest = [np.zeros(0, np.int64)] * len(tree.levels)
        self.dense = np.zeros(tree.width, np.int64)
        self.place = np.full(tree.levels[0].rows, -1, np.int64)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        self.scored = self.pairs = 0
        self._raise(floors.astype(np.int64))

    def _raise(self, floors: np.ndarray) -> None:
        self.weakest[0] = floors
        for i in range(1, len(self.weakest)):
            self.weakest[i] = np.minimum.reduceat(self.weakest[i - 1], np.arange(0, len(self.weakest[i - 1]), FANOUT))

    def settle(self) -> tuple[np.ndarray, ...]:
        """Cut what was found to the best ``k`` per item and raise the weakest scores."""
        if not self.found:
            return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, bool, np.int64))
        item, score, null, doc = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        best = order[nth < self.k]
        floors = self.weakest[0].copy()
        last = order[nth == self.k - 1]
        kept = tuple(np.concatenate(c) for c in zip(*self.found, strict=True))
        np.maximum.at(floors, kept[0][last], kept[1][last])
        self._raise(floors)
        self.found = [tuple(c[best] for c in kept)]
        self.held = len(best)
        return self.found[0]

    def block(self, docs: np.ndarray, nulls: np.ndarray, vectors: Sparse) -> None:
        """Search a block of documents, which stand in the order of the tree."""
        self.docs, self.nulls = docs, nulls
        nodes = [vectors, vectors.maxima(LEAF, self.tree.width)]
        while nodes[-1].rows > FANOUT:
            nodes.append(nodes[-1].maxima(FANOUT, self.tree.width))
        top = len(self.tree.levels) - 1
        for node in range(nodes[-1].rows):
            self._visit(nodes, len(nodes) - 1, node, top, np.arange(self.tree.levels[top].rows))

    def _visit(self, nodes: list[Sparse], depth: int, node: int, level: int, items: np.ndarray) -> None:
        below = nodes[depth]
        part = slice(below.ends[node], below.ends[node + 1])
        self.dense[below.columns[part]] = below.values[part]
        bounds = self.tree.levels[level].products(items, self.dense)
        self.dense[below.columns[part]] = 0
        self.pairs += len(items)
        items = items[(bounds > 0) & (bounds >= self.weakest[level][items])]
        if not len(items):
            return
        if level:
            items = _spans(items * FANOUT, np.minimum((items + 1) * FANOUT, self.tree.levels[level - 1].rows))
        if depth > 1:
            for child in range(node * FANOUT, min((node + 1) * FANOUT, nodes[depth - 1].rows)):
                self._visit(nodes, depth - 1, child, max(level - 1, 0), items)
            if depth == 2 and self.held > HELD:
                self.settle()
        elif level:
            self._visit(nodes, depth, node, level - 1, items)
        else:
            self._score(nodes[0], node * LEAF, min((node + 1) * LEAF, nodes[0].rows), items)

    def _score(self, vectors: Sparse, first: int, last: int, items: np.ndarray) -> None:
        part = slice(vectors.ends[first], vectors.ends[last])
        terms, impacts = vectors.columns[part], vectors.values[part]
        doc = np.repeat(np.arange(last - first), np.diff(vectors.ends[first : last + 1]))
        starts, ends = self.tree.by_term.ends[terms], self.tree.by_term.ends[terms + 1]
        at = _spans(starts, ends)
        self.place[items] = np.arange(len(items))
        place = self.place[self.tree.by_term.columns[at]]
        self.place[items] = -1
        wanted = np.flatnonzero(place >= 0)
        times = ends - starts
        values = self.tree.by_term.values[at[wanted]] * np.repeat(impacts, times)[wanted]
        scores = np.zeros(len(items) * (last - first), np.int64)
        np.add.at(scores, place[wanted] * (last - first) + np.repeat(doc, times)[wanted], values)
        self.scored += len(scores)
        scores = scores.reshape(len(items), last - first)
        i, d = np.nonzero((scores > 0) & (scores >= self.weakest[0][items][:, None]))
        if len(i):
            self.found.append((items[i], scores[i, d], self.nulls[first + d], self.docs[first + d]))
            self.held += len(i)


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of a term that occurs ``counts`` times in a document of ``lengths`` terms."""
    if len(lengths) and 75 * int(lengths.max()) * documents >= 1 << 62:
        damp = np.array([25 + 75 * n * documents // total for n in lengths.tolist()], np.int64)
    else:
        damp = 25 + 75 * lengths * documents // total
    return 1_000_000_000 * counts // (1000 * counts + 8 * damp)


def vectors_of(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document that has any term; only the given terms are listed."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            rows, sizes, ids, counts, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py() or b"")
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    rows.append(i)
                    sizes.append(len(words))
                    ids += found.keys()
                    counts += found.values()
                    ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (ids, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists],
                ["doc_id", "n", "terms", "counts"],
            )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], column.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents' ids, whether null, lengths, and their terms and counts, in blocks of bounded rows and terms."""
    held: list[pa.RecordBatch] = []
    rows = terms = 0

    def joined() -> tuple[np.ndarray, ...]:
        ends, ids = zip(*[_lists(b.column(2)) for b in held], strict=True)
        sizes = np.concatenate([np.diff(e) for e in ends])
        ids_of_docs = pa.concat_arrays([b.column(0) for b in held])
        return (
            ids_of_docs.fill_null(0).to_numpy(), ids_of_docs.is_null().to_numpy(zero_copy_only=False),
            np.concatenate([b.column(1).to_numpy() for b in held]), sizes,
            np.concatenate(ids), np.concatenate([_lists(b.column(3))[1] for b in held]),
        )

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, BLOCK_ROWS - rows)
            held.append(part)
            at += part.num_rows
            rows += part.num_rows
            terms += len(_lists(part.column(2))[1])
            if rows >= BLOCK_ROWS or terms >= BLOCK_TERMS:
                yield joined()
                held, rows, terms = [], 0, 0
    if held:
        yield joined()


def _sorted_block(block: tuple[np.ndarray, ...], weights: np.ndarray, documents: int, total: int) -> tuple:
    """A block in the order of its documents' heaviest coordinates: ids, nulls, vectors."""
    docs, nulls, lengths, sizes, terms, counts = block
    doc = np.repeat(np.arange(len(docs)), sizes)
    values = impacts(counts, lengths[doc], documents, total)
    kept = np.flatnonzero((weights[terms] > 0) & (values > 0))
    doc, terms, values = doc[kept], terms[kept], values[kept]
    share = weights[terms] * values
    by_share = np.lexsort((-share, doc))
    # The heaviest coordinate of every document that has one.
    heads = by_share[np.flatnonzero(np.concatenate([[True], doc[by_share][1:] != doc[by_share][:-1]]))] if len(doc) else by_share
    lead = np.full(len(docs), -1, np.int64)
    lead[doc[heads]] = terms[heads]
    order = np.lexsort((lengths, lead))
    order = order[lead[order] >= 0]
    place = np.full(len(docs), -1, np.int64)
    place[order] = np.arange(len(order))
    row = place[doc]
    by_row = np.lexsort((terms, row))
    ends = np.searchsorted(row[by_row], np.arange(len(order) + 1))
    return docs[order], nulls[order], Sparse(ends, terms[by_row], values[by_row])


def _search(vectors: DataFrame, items: list[dict[int, int]], weights: np.ndarray, k: int, size: tuple[int, int], floors: np.ndarray) -> DataFrame:
    """``item, doc_id, score`` of the best ``k`` documents per item of every task; ``item`` is a number."""
    held = vectors.sparkSession.sparkContext.broadcast((items, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, heavy, least = held.value
        tree = ItemTree(own, heavy)
        search = Search(tree, k, least[tree.order])
        for block in _blocks(batches):
            search.block(*_sorted_block(block, heavy, *size))
            search.settle()
        item, score, null, doc = search.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree.order[item], pa.int32()), pa.array(doc, pa.int64(), mask=null), pa.array(score, pa.int64())],
            ["item", "doc_id", "score"],
        )

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ranked(docs: DataFrame, group: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = group.toArrow()  # at most about GROUP_BYTES of text
    if not rows.num_rows:
        return spark.createDataFrame([], "item int, item_id string, rank int, doc_id long, score long")
    counted = [Counter(terms_of(t.as_py() or b"")) for t in rows.column("text")]
    terms = sorted(set().union(*counted))
    number = {t: i for i, t in enumerate(terms)}
    items = [{number[t]: n for t, n in c.items()} for c in counted]
    vectors = durable(vectors_of(docs, terms))
    documents, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held_by = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    weights = np.array([term_weight(documents, 0)] * len(terms), np.int64)
    for term, n in held_by.toLocalIterator():  # one row per term of the group
        weights[term] = term_weight(documents, n)
    size = (documents, max(total, 1))
    floors = np.zeros(len(items), np.int64)
    sample = vectors.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEEDS)) == 0)
    seeds = _best(_search(sample, items, weights, k, size, floors), k).filter(F.col("rank") == k)
    for item, score in seeds.select("item", "score").toLocalIterator():  # at most one row per item
        floors[item] = score
    names = spark.createDataFrame(pa.table({
        "item": pa.array(range(rows.num_rows), pa.int32()), "item_id": rows.column("item_id").combine_chunks(),
    }))
    return _best(_search(vectors, items, weights, k, size, floors), k).join(names, "item")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents with a score above 0 for every item."""
    wanted = items.select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    key, name = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    found = None
    for n in range(groups):
        group = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == n).orderBy("item_id", "text")
        ranked = _ranked(docs, group, k).select("item_id", "rank", F.col("doc_id").cast(key).alias("doc_id"), "score")
        found = ranked if found is None else found.unionByName(ranked)
    return found.select(F.col("item_id").cast(name).alias("item_id"), "rank", "doc_id", "score")
