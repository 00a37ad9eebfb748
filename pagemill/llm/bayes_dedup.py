"""MinHash near-dedup with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side, written
from .common import components, roots
from .subword_classifier import coded_words, text_groups

WORDS = 5
SHARE = 75  # hundredths: linked from this similarity on
# Signature and bands: a pair at the threshold shares no band with probability (1 - 0.75^5)^40 = 2e-5.
ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS
# Signatures are compared in batches of this many; a pair is pruned once its posterior chance of being similar
# falls below MISS.
BATCH = 40
MISS = 1e-5
# Before the last round, a bucket's members are compared inside cells of about this many.
CELL = 4
# In the last round a bucket is compared in tiles of about this many shingles a side.
TILE = 1 << 16
SEED = 7

_MIX = np.uint64(0x9E3779B97F4A7C15)


def hash_family(count: int = HASHES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, count, np.uint64)


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes."""
    rolled = np.full(len(words) - size + 1, size, np.uint64)
    for step in range(size):
        rolled = (rolled ^ words[step:len(words) - size + 1 + step]) * _MIX
        rolled ^= rolled >> np.uint64(29)
    return rolled


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; of the whole sequence if it is shorter; empty without words."""
    codes, distinct, counts = coded_words(texts)
    if not len(codes):
        return [np.empty(0, np.uint64)] * len(texts)
    words = pd.util.hash_array(distinct, categorize=False)[codes]
    runs = _rolled(words, WORDS) if len(words) >= WORDS else None
    sets, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            sets.append(np.unique(runs[at:at + n - WORDS + 1]))
        else:
            sets.append(_rolled(words[at:at + n], n) if n else np.empty(0, np.uint64))
        at += n
    return sets


def signature(items: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minimum of every hash over the set, taken in blocks so that long texts need no more memory."""
    least = np.full(len(family[0]), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(items), 2048):
        values = (items[at:at + 2048, None] * family[0] + family[1]) >> np.uint64(32)
        least = np.minimum(least, values.min(0).astype(np.uint32))
    return least


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, n_shingles, set_key, sig)``: set_key is a 128-bit digest of the full set, null for an empty one."""
    family = hash_family()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for group in text_groups(batch.column(1)):
                for items in shingle_sets(group):
                    sizes.append(len(items))
                    keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                    sigs.append(signature(items, family).astype("<u4").tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, sig binary")


def _band_rows(signed: DataFrame) -> DataFrame:
    """``(key, doc_id)`` per band of ``signed (doc_id, sig)``."""
    places = np.arange(HASHES).reshape(BANDS, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, HASHES).astype(np.uint64)
            keys = np.repeat(((np.arange(len(places), dtype=np.uint64) + np.uint64(1)) * _MIX)[None, :], len(sigs), 0)
            for step in range(places.shape[1]):
                keys = (keys ^ sigs[:, places[:, step]]) * _MIX
                keys ^= keys >> np.uint64(31)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), len(places)))],
                names=["key", "doc_id"])

    return signed.mapInArrow(run, "key bigint, doc_id bigint")


def _shared(rows: DataFrame) -> DataFrame:
    """``(key, doc_id, leader)`` of keys that more than one document has; the leader is the smallest id."""
    many = (rows.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("_last"))
            .filter("leader <> _last").select("key", "leader"))
    return rows.join(small_side(many, "buckets"), "key").select("key", "doc_id", "leader").distinct()


def least_matches(hashes: int = HASHES, batch: int = BATCH, share: float = SHARE / 100, miss: float = MISS) -> dict[int, int]:
    """Per number of compared hashes the least matches with which P(similarity >= share | matches) >= ``miss``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    table = {}
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while True:
            log = (math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                   + m * math.log(share) + (n + 1 - m) * math.log(1 - share))
            tail += math.exp(log)
            if tail >= miss:
                break
            m += 1
        table[n] = m
    return table


def prune(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose sizes allow the threshold and whose signatures pass every batch."""
    bounds = least_matches()
    left = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("_x"), F.col("n_shingles").alias("_m"))
    right = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("_y"), F.col("n_shingles").alias("_n"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b")
    met = met.filter(100 * F.least("_m", "_n") >= SHARE * F.greatest("_m", "_n")).select("a", "b", "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = np.arange(batch.num_rows)
            if len(alive):
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, HASHES) for i in (2, 3))
                matches = np.zeros(len(alive), np.int64)
                for n, least in bounds.items():
                    matches += (x[alive, n - BATCH:n] == y[alive, n - BATCH:n]).sum(1)
                    alive, matches = alive[matches >= least], matches[matches >= least]
            yield batch.select([0, 1]).take(pa.array(alive))

    return met.mapInArrow(run, "a bigint, b bigint")


def sets_of(texts: DataFrame) -> DataFrame:
    """``(doc_id, items)``: the sorted set of each text, eight bytes a shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [items.astype("<u8").tobytes() for group in text_groups(batch.column(1)) for items in shingle_sets(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["doc_id", "items"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, items binary")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("_s"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for at in range(batch.num_rows):
                one, two = (np.frombuffer(batch.column(i)[at].as_buffer(), "<u8") for i in (2, 3))
                both = np.concatenate([one, two])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                held.append(100 * common >= SHARE * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(held, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "_s", "_t").mapInArrow(run, "a bigint, b bigint")


def _mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows ``(key, doc_id)`` of keys that hold several components, with ``comp``, ``outside`` (not in the key's
    largest component) and ``n`` per key."""
    known = small_side(found.select(F.col("id").alias("doc_id"), F.col("component").alias("_c")), "found")
    rows = rows.select("key", "doc_id").join(known, "doc_id", "left").select("key", "doc_id", F.coalesce("_c", "doc_id").alias("comp"))
    sizes = written(rows.groupBy("key", "comp").agg(F.count("*").alias("_n")), "sizes")
    largest = (sizes.groupBy("key").agg(F.max_by("comp", F.struct("_n", "comp")).alias("_most"), F.sum("_n").alias("n"),
                                        F.count("*").alias("_comps"))
               .filter("_comps > 1").select("key", "_most", "n"))
    return written(rows.join(small_side(largest, "mixed"), "key")
                   .select("key", "doc_id", "comp", (F.col("comp") != F.col("_most")).alias("outside"), "n"), "mixed_rows")


def shareable(sets: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, shareable)``: how many shingles of each document some other of them has too.

    A shingle's documents are counted with partial sums, so one that all of them hold is a row per task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(v.as_buffer(), "<i8") for v in batch.column(1)]
            if held:
                owner = np.repeat(np.asarray(batch.column(0)), [len(h) for h in held])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(owner)], names=["item", "doc_id"])

    own = (sets.mapInArrow(run, "item bigint, doc_id bigint").groupBy("item")
           .agg(F.count("*").alias("_n"), F.min("doc_id").alias("doc_id")).filter("_n = 1")
           .groupBy("doc_id").agg(F.count("*").alias("_own")))
    size = F.octet_length("items") / 8
    return (sets.select("doc_id", size.cast("bigint").alias("n_shingles")).join(small_side(own, "own"), "doc_id", "left")
            .select("doc_id", "n_shingles", (F.col("n_shingles") - F.coalesce("_own", F.lit(0))).alias("shareable")))


def _cell_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """A few partners for every member of a mixed bucket: pairs inside small random cells of it, linear in its size."""
    cell = F.pmod(F.xxhash64("key", "doc_id"), F.ceil(F.col("n") / CELL))
    rows = _mixed(members, found).select("key", cell.alias("_cell"), "doc_id", "comp")
    one, two = rows.toDF("key", "_cell", "a", "_ca"), rows.toDF("key", "_cell", "b", "_cb")
    return one.join(two, ["key", "_cell"]).filter("a < b and _ca <> _cb").select("a", "b").distinct()


def _tile_links(outsiders: pa.Table, members: pa.Table) -> pa.Table:
    """Links of a tile's outsiders with its members, as a spanning forest ``(a, b)`` of the components they join.

    Each outsider passes the members through the bounds and the signature batches; the full sets of those left are
    intersected with its own.
    """
    names, bounds = ["a", "b"], least_matches()
    if not outsiders.num_rows or not members.num_rows:
        return pa.table([pa.array([], pa.int64())] * 2, names=names)

    def numbers(table: pa.Table, name: str) -> np.ndarray:
        return np.asarray(table.column(name)).astype(np.int64)

    def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    items = [joined(t, "items", "<u8") for t in (outsiders, members)]
    distinct, codes = np.unique(np.concatenate(items), return_inverse=True)
    own, other = codes[:len(items[0])], codes[len(items[0]):]
    m, n = (np.array([len(v.as_buffer()) // 8 for v in t.column("items")]) for t in (outsiders, members))
    ends, starts = np.cumsum(m), np.cumsum(n) - n
    x, y = (joined(t, "sig", "<u4").reshape(-1, HASHES) for t in (outsiders, members))
    (cx, p), (cy, q) = ((numbers(t, "comp"), numbers(t, "shareable")) for t in (outsiders, members))
    held, froms, tos = np.zeros(len(distinct), np.int32), [], []
    for i in range(len(m)):
        alive = np.flatnonzero((cy != cx[i]) & (np.minimum(p[i], q) * (100 + SHARE) >= SHARE * (m[i] + n)))
        matches = np.zeros(len(alive), np.int64)
        for count, least in bounds.items():
            matches += (y[alive, count - BATCH:count] == x[i, count - BATCH:count]).sum(1)
            alive, matches = alive[matches >= least], matches[matches >= least]
        if len(alive):
            mine = own[ends[i] - m[i]:ends[i]]
            held[mine] = 1
            common = np.add.reduceat(held[other], starts)[alive]
            held[mine] = 0
            linked = np.unique(cy[alive[100 * common >= SHARE * (m[i] + n[alive] - common)]])
            froms.append(np.full(len(linked), cx[i]))
            tos.append(linked)
    ids, place = np.unique(np.concatenate([np.empty(0, np.int64), *froms, *tos]), return_inverse=True)
    root = roots(len(ids), place[:len(place) // 2], place[len(place) // 2:])
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table([ids[root[moved]], ids[moved]], names=names)


def _crossing(members: DataFrame, found: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of components that meet in a bucket: what is outside its largest is compared with all of it.

    Members of one component need no comparison, so a group of near copies costs its outsiders only. Where many unlike
    documents meet, as those that share a common passage do, most of their shingles are their own: what a document
    shares with any other bounds its similarity to all, and those that can reach the threshold with no member go
    first. A bucket is dealt to tiles of bounded size, outsiders by members, and only a tile's links leave it: no pair
    becomes a row.
    """
    rows = _mixed(members, found)
    docs = small_side(rows.select("doc_id").distinct(), "mixed_docs")
    bounds = small_side(shareable(sets.join(docs, "doc_id", "left_semi")), "bounds")
    rows = rows.join(bounds, "doc_id")
    least = rows.groupBy("key").agg(F.min("n_shingles").alias("_least"))
    rows = rows.join(small_side(least, "least"), "key")
    partner = F.greatest(F.col("_least"), F.ceil(F.col("n_shingles") * SHARE / 100))
    rows = written(rows.filter(F.col("shareable") * (100 + SHARE) >= SHARE * (F.col("n_shingles") + partner))
                   .select("key", "doc_id", "comp", "outside", "n_shingles", "shareable"), "able")
    tiles = (rows.groupBy("key").agg(F.ceil(F.sum("n_shingles") / TILE).cast("int").alias("_members"),
                                     F.ceil(F.sum(F.when(F.col("outside"), F.col("n_shingles"))) / TILE).cast("int").alias("_outsiders"))
             .filter("_outsiders > 0"))
    rows = rows.join(small_side(tiles, "tiles"), "key")
    held = sigs.select("doc_id", "sig").join(sets, "doc_id")

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        """Each row in its own part of the bucket, once per part of the other side."""
        df = (df.withColumn(mine, F.pmod(F.xxhash64("doc_id"), F.col(own)))
              .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))))
        df = df.select("key", F.col("_x").cast("int"), F.col("_y").cast("int"), "doc_id", "comp", "shareable").join(held, "doc_id")
        return df.toDF(*df.columns).groupBy("key", "_x", "_y")  # columns of its own, for both sides stem from one table

    asks = dealt(rows.filter("outside"), "_outsiders", "_members", "_x", "_y")
    holds = dealt(rows, "_members", "_outsiders", "_y", "_x")
    return asks.cogroup(holds).applyInArrow(_tile_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every row; ids are integers.

    Documents are linked when their sets of five-word shingles have a similarity of at least 0.75. Equal sets
    are one class from the start, represented by its smallest id. Classes meet in band buckets. First every class is
    compared with the leader it shares most bands with, then, where a bucket still holds several components, with a
    few members of its cell there; last, in buckets that are still mixed, what is outside the largest component is
    compared with all the rest. Signatures prune by posterior, survivors are confirmed on full sets.

    Null and empty texts have no shingles and link with nothing, as do rows with a null id, which are kept. Rows
    that repeat an id are one node. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(sign(rows, "doc_id", "text"), "signed")
    classes = (signed.filter("set_key is not null and doc_id is not null").groupBy("set_key")
               .agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last")).filter("rep <> _last").select("set_key", "rep"))
    member = signed.join(small_side(classes, "classes"), "set_key", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    lone = member.filter("set_key is not null and doc_id = rep").select("doc_id", "sig")
    members = written(_shared(_band_rows(lone)), "members")

    wanted = small_side(members.select("doc_id").distinct(), "wanted")
    sigs = signed.filter("set_key is not null").join(wanted, "doc_id", "left_semi").select("doc_id", "n_shingles", "sig")
    texts = rows.join(wanted, "doc_id", "left_semi")
    if signed.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").take(1):  # repeated rows: one of each suffices
        sigs, texts = sigs.distinct(), texts.distinct()
    sigs = written(sigs, "member_sigs")
    sets = written(sets_of(texts), "member_sets")

    def links(pairs: DataFrame) -> DataFrame:
        return written(confirm(prune(pairs, sigs), sets).distinct(), "links")

    stars = members.filter("doc_id <> leader").groupBy("leader", "doc_id").agg(F.count("*").alias("_n"))
    stars = stars.groupBy(F.col("doc_id").alias("b")).agg(F.max_by("leader", F.struct("_n", "leader")).alias("a"))
    known = links(stars.select("a", "b"))
    found = components(known)
    known = known.union(links(_cell_pairs(members, found)))
    found = components(known)
    last = written(_crossing(members, found, sigs, sets), "links")
    if last.take(1):
        found = components(known.union(last))
    found = small_side(found.select(F.col("id").alias("rep"), "component"), "components")
    return (member.join(found, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
            .select(F.col("doc_id").alias(key), "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
