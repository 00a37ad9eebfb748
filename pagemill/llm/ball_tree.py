"""Ranked lexical search: exact inner products of sparse term vectors, found best-first in ball trees."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, written
from .subword_classifier import text_groups

TOP = 20
# Fixed values of the score: what a term's frequency saturates to, in thousandths, and the share of the length (percent).
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 12, 25
# Documents per tree and per leaf.
TREE, LEAF = 4096, 32
# Items searched together; their terms are what a task holds of them.
ITEM_BLOCK = 1024
# Bounds are widened by this share of the magnitudes that went into them: far more than doubles lose.
SLACK = 1e-9

# Bytes of ASCII that part terms; A-Z are lower-cased, all else stands as it is.
_TERMS = bytes(c if chr(c).isalnum() or c > 0x7F else 0x20 for c in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(item_id, term, times)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(t.as_py() or b"")) for t in batch.column(1).cast(pa.binary())]
            row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array([t.decode("utf-8", "replace") for c in counts for t in c], pa.string()),
                 pa.array([n for c in counts for n in c.values()], pa.int64())], names=["item_id", "term", "times"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"item_id {kind}, term string, times bigint")


def term_counts(docs: DataFrame, vocabulary: list[str], key: str, text: str) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: terms of each whole text with repeats, and those of ``vocabulary`` with frequencies."""
    kind = docs.schema[key].dataType.simpleString()
    number = {t.encode(): i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers, tfs, offsets = [], [], [], [0]
            for group in text_groups(batch.column(1)):
                for text_bytes in group:
                    terms = terms_of(text_bytes)
                    known = np.fromiter((number.get(t, -1) for t in terms), np.int32, len(terms))
                    distinct, count = np.unique(known[known >= 0], return_counts=True)
                    sizes.append(len(terms))
                    numbers.append(distinct)
                    tfs.append(count)
                    offsets.append(offsets[-1] + len(distinct))
            at = pa.array(offsets, pa.int32())
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *part]), kind) for part, kind in
                    ((numbers, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()),
                                              *(pa.ListArray.from_arrays(at, f) for f in flat)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


class Rows:
    """Sparse integer vectors: the entries of row ``i`` lie at ``at[i]:at[i + 1]``."""

    def __init__(self, columns: np.ndarray, values: np.ndarray, at: np.ndarray):
        self.columns, self.values, self.at = columns, values, at
        self.square = self._sums(values.astype(np.float64) ** 2)

    def _sums(self, each: np.ndarray) -> np.ndarray:
        """Row sums, each row added up by itself, so that no row's rounding falls on another; no row is empty."""
        return np.add.reduceat(each, self.at[:-1]) if len(each) else each

    def part(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.at)[rows]
        at = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(at[-1]) - np.repeat(at[:-1], sizes) + np.repeat(self.at[rows], sizes)
        return Rows(self.columns[index], self.values[index], at)

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Inner products with one dense vector, in its number type: exact for integers."""
        return self._sums(self.values.astype(dense.dtype) * dense[self.columns])

    def dense(self, row: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        out[self.columns[self.at[row]:self.at[row + 1]]] = self.values[self.at[row]:self.at[row + 1]]
        return out


class Tree:
    """Balls over rows: each node has a centroid and a radius that no row of it exceeds, leaves hold at most ``leaf`` rows.

    A node is halved by how much nearer its rows are to the one of two far rows than to the other, so trees are balanced.
    """

    def __init__(self, rows: Rows, width: int, leaf: int = LEAF):
        centroids, radii, supports, self.children, self.leaves = [], [], [], [], {}
        todo = [(np.arange(len(rows.at) - 1), -1)]
        while todo:
            members, parent = todo.pop()
            node, inside = len(centroids), rows.part(members)
            if parent >= 0:
                self.children[parent].append(node)
            self.children.append([])
            centroid = np.bincount(inside.columns, inside.values.astype(np.float64), width) / len(members)
            square = float(centroid @ centroid)
            # the squares are large and their difference may be small: what rounding takes is given back to the radius
            distance = inside.square - 2.0 * inside.dot(centroid) + square
            radii.append(float(np.sqrt(max(distance.max(), 0.0) + SLACK * (inside.square.max() + square))))
            centroids.append(centroid)
            supports.append(centroid > 0)  # entries are positive, so these are the columns any row of the node has
            if len(members) <= leaf:
                self.leaves[node] = (members, inside)
                continue
            far = inside.dense(int(distance.argmax()), width)
            first = inside.square - 2.0 * inside.dot(far)
            second = inside.dense(int(first.argmax()), width)
            order = members[np.argsort(first - inside.square + 2.0 * inside.dot(second), kind="stable")]
            todo += [(order[:len(order) // 2], node), (order[len(order) // 2:], node)]
        self.centroids, self.radii, self.supports = np.stack(centroids), np.array(radii), np.stack(supports)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Per query and node what no row of the node can exceed: q.c + |q| r, with q narrowed to columns of the node."""
        size = np.sqrt((queries ** 2) @ self.supports.T)
        length = np.sqrt((self.centroids ** 2).sum(1))
        return queries @ self.centroids.T + size * self.radii + SLACK * size * (length + self.radii) + 1.0


def search(tree: Tree, query: np.ndarray, bounds: np.ndarray, keys: np.ndarray, best: list, top: int) -> int:
    """Put the rows of the tree that belong there into ``best``, a heap of (score, -key place); returns leaves opened.

    Nodes are taken by bound, highest first, and the search ends at the first below the lowest of a full ``best``: a bound
    equal to it may hide a tie with a smaller key, so that one is still opened.
    """
    opened, queue = 0, [(-bounds[0], 0)]
    while queue:
        bound, node = heapq.heappop(queue)
        if -bound < (best[0][0] if len(best) == top else 1):
            break
        for child in tree.children[node]:
            heapq.heappush(queue, (-bounds[child], child))
        if node in tree.leaves:
            opened += 1
            members, inside = tree.leaves[node]
            scores = inside.dot(query)
            least = best[0][0] if len(best) == top else 1
            for row in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[row]), -int(keys[members[row]]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
    return opened


def _best_of_part(queries: np.ndarray, weights: np.ndarray, n_docs: int, length: int, top: int):
    """The task: trees over runs of its rows, one after another; a query's best so far prunes the trees to come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        dense = [q * weights for q in queries]
        real = np.stack(dense).astype(np.float64)
        held: list[pa.RecordBatch] = []

        def grown() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keys, n = table["doc_id"].to_numpy(), table["n"].to_numpy()
            terms, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
            if isinstance(terms, pa.ChunkedArray):
                terms, tfs = terms.chunk(0), tfs.chunk(0)
            at = np.asarray(terms.offsets).astype(np.int64)
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // length
            tf = np.asarray(tfs.values).astype(np.int64)[at[0]:at[-1]]
            values = SCALE * tf // (1000 * tf + SATURATION * np.repeat(m, np.diff(at)))
            rows = Rows(np.asarray(terms.values)[at[0]:at[-1]], values, at - at[0])
            tree = Tree(rows, len(weights))
            bounds = tree.bounds(real)
            for number, query in enumerate(dense):
                search(tree, query, bounds[number], keys, best[number], top)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TREE:
                grown()
        if sum(b.num_rows for b in held):
            grown()
        rows = [(i, -key, score) for i, found in enumerate(best) for score, key in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)],
                                         names=["_item", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
                   item_key: str = "item_id", item_text: str = "text", item_block: int = ITEM_BLOCK) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` documents with a score above 0, ties by key.

    Terms are counted once over whole texts and written, narrowed to the items' terms: nothing else has part in an
    inner product. Every task builds ball trees over its rows and searches them for all items of a block, so a task returns
    at most ``top`` rows per item and the last ranking sorts those alone. Items are taken in blocks, whose terms are the
    only thing that goes to all tasks. A term no document holds weighs like the others and meets nothing.

    Null or empty texts have no terms and are never found; rows with a null key cannot be named and only count in the
    statistics; repeated rows are documents of their own. Repeated item ids are one item, with the terms of all their rows.
    Items without terms have no rows. Empty tables give an empty result, other columns are ignored.
    """
    spark, kind = docs.sparkSession, items.schema[item_key].dataType.simpleString()
    asked = written(item_terms(items, item_key, item_text).groupBy("item_id", "term").agg(F.sum("times").alias("times")), "items")
    blocks = -(-asked.select("item_id").distinct().count() // item_block)
    parts = []
    for block in range(blocks):
        of_block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = of_block.collect()  # about item_block items
        names = sorted({r.item_id for r in rows}, key=lambda n: (n is not None, n))
        vocabulary = sorted({r.term for r in rows})
        if not rows:
            continue
        counts = written(term_counts(spread(docs), vocabulary, key, text), "counts")
        stats = counts.filter("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).head()
        if not stats.n:
            continue
        df = counts.select(F.explode("terms").alias("term")).groupBy("term").count()
        weight = F.floor(1000 * F.log((2 * F.lit(stats.n) + 2) / (2 * F.col("count") + 1))).cast("bigint")
        weights = np.zeros(len(vocabulary), np.int64)
        for r in df.select("term", weight.alias("w")).collect():  # at most the vocabulary
            weights[r.term] = r.w
        place, number = {t: i for i, t in enumerate(vocabulary)}, {n: i for i, n in enumerate(names)}
        queries = np.zeros((len(names), len(vocabulary)), np.int64)
        for r in rows:
            queries[number[r.item_id], place[r.term]] = r.times
        best = (counts.filter("doc_id is not null and size(terms) > 0")
                .select(F.col("doc_id").cast("bigint").alias("doc_id"), "n", "terms", "tfs")
                .mapInArrow(_best_of_part(queries, weights, stats.n, stats.l, top), "_item bigint, doc_id bigint, score bigint"))
        named = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"_row bigint, item_id {kind}"))
        parts.append(best.join(named, F.col("_item") == F.col("_row")).select("item_id", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    every = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return (every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))
