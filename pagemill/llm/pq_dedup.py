"""Embedding near-dedup: coarse inverted lists, product-quantised residuals, table-lookup distances, exact rerank."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side, written
from .common import components, roots

COSINE = 0.93
# The index is fitted on at most this many vectors, those with the smallest hashed ids; every vector is indexed.
SAMPLE = 16_384
SUBSPACES, CODES = 8, 256
# Zones of lists meet queries in tiles of about this many rows and queries.
TILE_ROWS, TILE_QUERIES = 2048, 4096
# So many exact cosines at a time.
PAIRS = 65_536
SEED = 5


@dataclass
class Index:
    """Coarse centroids, and per subspace of the residual a table of codewords."""

    centroids: np.ndarray
    words: np.ndarray  # subspace, code, dimension
    before: np.ndarray  # share of the sample in earlier lists

    def zones(self, lists: np.ndarray, count: int) -> np.ndarray:
        """Zone of each list where ``count`` zones of about equal size are cut."""
        return np.floor(self.before[lists] * count).astype(np.int64)

    def residual_parts(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = vectors - self.centroids[lists]
        width = self.words.shape[0] * self.words.shape[2]
        rest = np.pad(rest, ((0, 0), (0, width - rest.shape[1])))
        return rest.reshape(len(rest), self.words.shape[0], -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by the largest component, so extreme values neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.argmin(half - vectors[at:at + 4096] @ centres.T, 1) for at in range(0, len(vectors), 4096)]
                          or [np.empty(0, np.int64)])


def _k_means(vectors: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = vectors[rng.choice(len(vectors), min(count, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = _nearest(vectors, centres)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, vectors)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, lists: int) -> Index:
    rng = np.random.default_rng(SEED)
    centroids = _k_means(sample, lists, rng)
    # along the longest axis, so that a zone of lists is near each other
    axis = np.linalg.svd(centroids - centroids.mean(0), full_matrices=False)[2][0]
    centroids = centroids[np.argsort(centroids @ axis, kind="stable")]
    near = _nearest(sample, centroids)
    size = np.bincount(near, minlength=len(centroids))
    width = -(-sample.shape[1] // SUBSPACES)
    # an empty list at the end has all before it: kept below 1, for a zone of its own would not exist
    before = np.minimum((np.cumsum(size) - size) / len(sample), 1 - 1e-9)
    index = Index(centroids, np.zeros((SUBSPACES, 1, width)), before)
    parts = index.residual_parts(sample, near)
    index.words = np.stack([_k_means(parts[:, m], CODES, rng) for m in range(SUBSPACES)])
    return index


def encode(vectors: np.ndarray, lists: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the residuals, and the length of what they leave out."""
    parts = index.residual_parts(vectors, lists)
    codes = np.stack([_nearest(parts[:, m], index.words[m]) for m in range(len(index.words))], 1)
    left_out = parts - np.stack([index.words[m][codes[:, m]] for m in range(len(index.words))], 1)
    return codes.astype(np.uint8), np.sqrt((left_out ** 2).sum((1, 2)))


def reachable(queries: np.ndarray, own: np.ndarray, lists: np.ndarray, index: Index, cosine: float) -> np.ndarray:
    """Which of ``lists`` may hold a link of each query: it is within reach of the border between its own list and theirs.

    Every list that holds a link is among them; there is no limit to their number.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    c, mine = index.centroids[lists], index.centroids[own]
    square, mine_square = (c ** 2).sum(1), (mine ** 2).sum(1)
    gap = np.sqrt(np.maximum(mine_square[:, None] + square - 2 * mine @ c.T, 0))
    border = square - mine_square[:, None] - 2 * (queries @ c.T - (queries * mine).sum(1)[:, None])
    return border <= 2 * reach * gap + 1e-9


def asked_zones(queries: np.ndarray, own: np.ndarray, counts: np.ndarray, index: Index, cosine: float) -> list[np.ndarray]:
    """Zones with a list that may hold a link, of each query; ``counts`` has the number of its label's zones."""
    out = []
    for at in range(0, len(queries), 1024):
        part = slice(at, at + 1024)
        ok = reachable(queries[part], own[part], np.arange(len(index.centroids)), index, cosine)
        out.extend(np.unique(index.zones(np.flatnonzero(row), n)) for row, n in zip(ok, counts[part]))
    return out


def _stack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(np.asarray(column.flatten(), np.float64).reshape(-1, dim))


def _usable(embedding: Column) -> Column:
    """Finite components, none null, not all zero."""
    numbers = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return numbers & F.exists(embedding, lambda x: x != 0)


def _assign(rows: DataFrame, index: Index, dim: int, cosine: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, counts = _stack(batch.column(3), dim), np.asarray(batch.column(4))
            lists = _nearest(vectors, index.centroids)
            codes, error = encode(vectors, lists, index)
            zones = np.floor(index.before[lists] * counts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                 pa.array(zones.astype(np.int32)), pa.array(asked_zones(vectors, lists, counts, index, cosine), pa.list_(pa.int32()))],
                names=[*batch.schema.names[:4], "list", "codes", "error", "zone", "asked"])

    schema = ("id bigint, label string, n bigint, vec array<double>, list int, codes binary, error double, zone int, "
              "asked array<int>")
    return rows.select("id", "label", "n", "vec", "zones").mapInArrow(run, schema)


def _tile_links(dim: int, index: Index, cosine: float):
    """Function of a tile: link counts of its queries, and a spanning forest of its links."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names, empty = ["id", "links", "root"], pa.table({n: pa.array([], pa.int64()) for n in ("id", "links", "root")})
        if not queries.num_rows or not rows.num_rows:
            return empty
        queries = queries.sort_by("list")  # a block of queries then reaches much the same lists
        q_id, r_id = (np.asarray(t.column("id")).astype(np.int64) for t in (queries, rows))
        q, r = _stack(queries.column("vec"), dim), _stack(rows.column("vec"), dim)
        own, counts, error = (np.asarray(c) for c in (queries.column("list"), rows.column("n"), rows.column("error")))
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(r), -1).astype(np.int64)
        lists, list_at = np.unique(np.asarray(rows.column("list")), return_inverse=True)
        width = index.words.shape[2]
        padded = np.pad(q, ((0, 0), (0, len(index.words) * width - dim))).reshape(len(q), len(index.words), width)
        ids, place = np.unique(np.concatenate([q_id, r_id]), return_inverse=True)
        q_at, r_at = place[:len(q)], place[len(q):]
        links, froms, tos = np.zeros(len(q), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            held = np.flatnonzero(reachable(q[part], own[part], lists, index, cosine).any(0)[list_at])
            if not len(held):
                continue
            near = (q[part] @ index.centroids[lists].T)[:, list_at[held]]
            for m in range(len(index.words)):
                near += (padded[part, m] @ index.words[m].T)[:, codes[held, m]]
            # what the codes leave out moves a cosine by its length at most: nothing above the threshold is lost
            i, j = np.nonzero(near + error[held] >= cosine - 1e-9)
            i, j = i + at, held[j]
            # in parts, for in a dense group all pairs come so far
            exact = np.concatenate([np.einsum("ij,ij->i", q[i[k:k + PAIRS]], r[j[k:k + PAIRS]]) >= cosine
                                    for k in range(0, len(i), PAIRS)] or [np.empty(0, bool)])
            i, j = i[exact], j[exact]
            other = q_id[i] != r_id[j]
            i, j = i[other], j[other]
            links += np.bincount(i, counts[j], len(q)).astype(np.int64)
            root = roots(len(ids), q_at[i], r_at[j])
            moved = np.flatnonzero(root != np.arange(len(ids)))
            froms.append(moved)
            tos.append(root[moved])
        root = roots(len(ids), np.concatenate(froms), np.concatenate(tos))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        told = np.flatnonzero(links)
        return pa.table([np.concatenate([q_id[told], ids[moved]]), np.concatenate([links[told], np.zeros(len(moved), np.int64)]),
                         np.concatenate([q_id[told], ids[root[moved]]])], names=names)

    return run


def _links_of(classes: DataFrame, dim: int, cosine: float, sample: int) -> DataFrame:
    """``(id, links, root)`` rows of one dimension; ``classes`` has ``id, label, n, vec``."""
    total = classes.count()
    lists = max(1, min(4096, int(math.sqrt(total))))
    chosen = classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow()
    index = fit(_stack(chosen.column(0), dim), lists)
    # a label's lists lie in zones of about a tile's rows; a query goes once to each zone that can hold a link
    zones = classes.groupBy("label").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("zones"))
    indexed = written(_assign(classes.join(small_side(zones, "zones"), "label"), index, dim, cosine), "indexed")
    # how many tiles each zone is cut into, by its rows and by the queries that ask it
    keys = ["label", "zone"]
    by_zone = indexed.groupBy(*keys).agg(F.count("*").alias("_r"))
    asked = indexed.select("label", F.explode("asked").alias("zone")).groupBy(*keys).agg(F.count("*").alias("_q"))
    tiles = small_side(by_zone.join(asked, keys).select(
        *keys, F.ceil(F.col("_r") / TILE_ROWS).cast("int").alias("_rows"),
        F.ceil(F.col("_q") / TILE_QUERIES).cast("int").alias("_queries")), "tiles")

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        """Each row in its own part of the zone, once per part of the other side."""
        return (df.join(tiles, keys).withColumn(mine, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
                .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_rows", "_queries"))

    asks = dealt(indexed.select("id", "label", "vec", "list", F.explode("asked").alias("zone")), "_queries", "_rows", "_qt", "_rt")
    holds = dealt(indexed.select("id", "label", "n", "vec", "list", "zone", "codes", "error"), "_rows", "_queries", "_rt", "_qt")
    holds = holds.toDF(*holds.columns)  # columns of its own, for both sides stem from one table
    tile = ["label", "zone", "_rt", "_qt"]
    return asks.groupBy(*tile).cogroup(holds.groupBy(*tile)).applyInArrow(
        _tile_links(dim, index, cosine), "id bigint, links bigint, root bigint")


def linked_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                   cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every vector.

    Vectors are linked when their labels are equal and their cosine, in double precision, is at least ``cosine``.
    Equal vectors of a label are one class with a count. Null labels, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing; neither do vectors of different lengths. Rows with a null id are kept and link with
    nothing; rows that repeat an id with the same vector count once. An empty table gives an empty result.

    No link is lost: every list that can hold one is probed, and the lookup distance is compared with the threshold less
    what its codes leave out. Lists are gathered in zones, a zone is cut into tiles of bounded size; a tile returns counts and a spanning forest of its
    links, never all pairs.
    """
    vec = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), vec.alias("vec"))
    good = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vec")))
    hashed = good.withColumn("h", F.xxhash64("vec")).withColumn("g", F.xxhash64(F.lit(1), "vec"))
    members = written(hashed.select("id", "label", "h", "g").distinct(), "vector_members")
    groups = members.groupBy("label", "h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    groups = written(groups, "vector_classes")
    reps = small_side(groups.select(F.col("rep").alias("id"), "label", "h", "g", "n"), "representatives")
    classes = written(hashed.join(reps, ["id", "label", "h", "g"]).select("id", "label", "n", "vec").dropDuplicates(["id", "label"]),
                      "representatives")
    found = None
    for (dim,) in classes.select(F.size("vec")).distinct().collect():
        part = _links_of(classes.filter(F.size("vec") == dim), dim, cosine, sample)
        found = part if found is None else found.union(part)
    if found is None:
        found = classes.select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("root")).limit(0)
    found = written(found, "vector_links")
    roots = components(found.filter("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    several = small_side(groups.filter("n > 1").select("label", "h", "g", "rep", "n"), "several")
    member = members.join(several, ["label", "h", "g"], "left").select(
        "id", F.coalesce("rep", "id").alias("rep"), F.coalesce(F.col("n"), F.lit(1)).alias("n"))
    linked = (member.join(small_side(counts.select(F.col("id").alias("rep"), "links"), "counts"), "rep", "left")
              .join(small_side(roots.select(F.col("id").alias("rep"), "component"), "roots"), "rep", "left")
              .groupBy("id").agg(F.sum(F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                 F.min(F.coalesce("component", "rep")).alias("component_id")))
    return (rows.select("id").join(linked, "id", "left")
            .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"),
                    F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept")))
