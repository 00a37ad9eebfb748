"""Suffix-array dedup: passages that an earlier document holds, found by a distributed difference-cover algorithm.

A string of ``WIDTH`` bytes repeats when two suffixes agree on so many bytes, that is, when they are neighbours in the
suffix array up to that depth. Positions are taken modulo 3 from their text's start; {1, 2} is a difference cover: for any
two positions one of the shifts 0, 1, 2 brings both into it. So it is enough to sort the sampled suffixes:

* **Names.** A sampled suffix is named by triples, recursively: three bytes make a triple, three triples a name of 9 bytes,
  three of these a name of 27, and two of those, overlapping, the name of 48 bytes. A name is a fingerprint of 96 bits, not a
  rank: only equal prefixes matter here, so names need to be equal for equal strings and any one order of them will do.
* **Sort.** Names are dealt to ranges and sorted there; neighbours with equal names are compared.
* **Merge.** A suffix that is not sampled lies one or two bytes before one that is. Each sampled suffix brings the two
  bytes before and the two behind its 48; neighbours agree on the ``WIDTH`` bytes at shift 0, 1 or 2 where these do.

Three things keep the sorted suffixes few. Windows are sampled by the least name of 27, then of 41 bytes inside them, and only
those whose least name stands in two documents go on (equal windows have equal least names, so none is lost). Runs of windows with one least
name that an earlier document holds whole are settled by one fingerprint for all of the run. And what one batch of texts holds
several times leaves it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side, written
from .common import text_of

WIDTH = 50
# Fixed by the recursion on triples: a name of three levels, and the sampled suffixes' prefix that leaves shifts 0 to 2 room.
GRAM, PREFIX = 27, WIDTH - 2
# A second look at what is left takes longer names, which fewer windows share by chance or by a part of themselves.
LONG_GRAM = 41
# Texts are worked on in batches of about so many bytes; longer ones are cut, with the overlap that windows need.
BATCH = 1 << 20
# A range of names holds what comes of about so many bytes of text: least names are short and few, suffixes are neither.
NAME_RANGE, RUN_RANGE, SUFFIX_RANGE = 32 << 20, 24 << 20, 8 << 20

# Not a place: a text with this mark holds some of its strings several times, and has asked for them once.
AGAIN = (1 << 32) - 1

_SEEN = np.dtype([("lo", "<u4"), ("hi", "u1")])
_SPAN = np.dtype([("at", "<u4"), ("to", "<u4")])
_RUN = np.dtype([("a", "<u8"), ("b", "<u4"), ("at", "<u4"), ("size", "u1")])
_SUFFIX = np.dtype([("a", "<u8"), ("b", "<u4"), ("context", "<u4"), ("valid", "u1"), ("at", "<u4")])
# What is known of one text: its id, a hash that parts texts of one id, and records.
_EXCHANGED = "part int, told boolean, ids binary, hashes binary, counts binary, records binary"
_FOUND = "_id bigint, _hash bigint, _records binary"

_BLOCK = 1 << 15
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _triple(x: np.ndarray, step: int, seed: int) -> np.ndarray:
    """Names of three equal parts that lie ``step`` apart; in blocks that fit a core's cache."""
    size = len(x) - 2 * step
    out, spare = np.empty(size, np.uint64), np.empty(min(size, _BLOCK), np.uint64)
    for lo in range(0, size, _BLOCK):
        hi = min(lo + _BLOCK, size)
        part, shifted = out[lo:hi], spare[:hi - lo]
        np.bitwise_xor(x[lo:hi], np.uint64(seed), out=part)
        for factor, shift, beyond in ((_M1, 29, step), (_M2, 31, 2 * step), (_M3, 30, 0)):
            part *= factor
            np.right_shift(part, np.uint64(shift), out=shifted)
            part ^= shifted
            if beyond:
                part ^= x[lo + beyond:hi + beyond]
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (a >> np.uint64(32))) * _M2
    out ^= b
    out *= _M1
    out ^= out >> np.uint64(29)
    return out


def nines(data: np.ndarray) -> np.ndarray:
    """The name of the 9 bytes at every position: three triples of bytes."""
    bytes_ = data.astype(np.uint32)
    triples = bytes_[:-2] << np.uint32(16)
    triples |= bytes_[1:-1] << np.uint32(8)
    triples |= bytes_[2:]
    return _triple(triples.astype(np.uint64), 3, 11)


def grams(data: np.ndarray) -> np.ndarray:
    """The name of the 27 bytes at every position, by three levels of triples."""
    return _triple(nines(data), 9, 13)


def prints(names: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """One name for the bytes that the names at ``at`` and ``to`` cover together."""
    return _pair(names[at], names[to])


def long_grams(data: np.ndarray) -> np.ndarray:
    """The name of the 41 bytes at every position: two overlapping names of 27."""
    names = grams(data)
    return _pair(names[:len(names) - (LONG_GRAM - GRAM)], names[LONG_GRAM - GRAM:])


def least_grams(names: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The least name inside the window at every position."""
    inside = WIDTH - gram + 1
    out = np.empty(len(names) - inside + 1, np.uint64)
    for lo in range(0, len(out), _BLOCK):
        hi, held = min(lo + _BLOCK, len(out)), 1
        least = names[lo:hi + inside - 1]
        while 2 * held <= inside:
            least, held = np.minimum(least[:-held], least[held:]), 2 * held
        np.minimum(least[:hi - lo], least[inside - held:inside - held + hi - lo], out=out[lo:hi])
    return out


class Pieces:
    """Parts of texts end to end: ``row`` and ``offset`` per part, and its bytes at ``at[i]:at[i + 1]`` of ``data``."""

    def __init__(self, parts: list[tuple[int, int, bytes]]):
        self.row = np.array([p[0] for p in parts], np.int64)
        self.offset = np.array([p[1] for p in parts], np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)

    def part(self, of: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, of, "right") - 1

    def places(self, of: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Where these places of ``data`` lie in their texts."""
        return of + (self.offset - self.at[:-1])[part]

    def whole(self, length: int) -> np.ndarray:
        """Whether so many bytes of one part begin at each place where they could."""
        inside = np.ones(len(self.data), bool)
        ends = self.at[1:, None] - np.arange(1, length)
        inside[np.maximum(ends, self.at[:-1, None]).ravel()] = False  # no part is empty
        return inside[:len(self.data) - length + 1]

    def runs(self, names: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, size, name)`` of runs of at most ``WIDTH`` windows, one after another, with one least name.

        Two windows that lie at most ``WIDTH`` apart cover all between them, so the first and the last stand for a run.
        """
        least, whole = least_grams(names, gram), self.whole(WIDTH)
        new = whole.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
        stop = whole.copy()
        stop[:-1] &= new[1:] | ~whole[1:]
        start, last = np.flatnonzero(new), np.flatnonzero(stop)
        size = last - start + 1
        if len(size) and size.max() > WIDTH:
            times = -(-size // WIDTH)
            turn = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            size = np.minimum(np.repeat(size, times) - turn * WIDTH, WIDTH)
            start = np.repeat(start, times) + turn * WIDTH
        least = least[start]  # least names are small numbers, so they are mixed anew before they are dealt to ranges
        return start, size, _pair(least, least >> np.uint64(7))


def parts_of(texts: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in batches of about ``BATCH`` bytes; a long text in overlapping parts, so that every window and every sampled
    suffix lies whole, with its two bytes on either side, in one of them."""
    held, size = [], 0
    for row, text in texts:
        for start in range(0, max(len(text), 1), BATCH):
            part = text[max(start - 2, 0):start + BATCH + WIDTH]
            if len(part) < WIDTH:
                continue
            held.append((row, max(start - 2, 0), part))
            size += len(part)
            if size >= BATCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _changes(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _sorted_by(key: np.ndarray) -> np.ndarray:
    """An order by the high bits of 64, equal ones by place: numbers in one array sort much faster than an argsort."""
    bits = np.uint64(max(len(key) - 1, 1).bit_length())
    packed = key >> bits << bits
    packed |= np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _in_order(part: np.ndarray, row: np.ndarray) -> np.ndarray:
    """An order by part, then row, then place; all small numbers."""
    bits = [np.uint64(max(int(x.max()) if len(x) else 0, 1).bit_length()) for x in (row, np.arange(len(part)))]
    key = part.astype(np.uint64) << bits[0] | row.astype(np.uint64)
    packed = key << bits[1] | np.arange(len(part), dtype=np.uint64)
    packed.sort()
    return (packed & ((np.uint64(1) << bits[1]) - np.uint64(1))).astype(np.int64)


# ---- questions that texts put to ranges of names, and answers that come back per text ----

def _packed(records: np.ndarray) -> bytes:
    """Records byte plane by byte plane, compressed: places and neighbours shrink, names do not."""
    planes = records.view(np.uint8).reshape(len(records), records.itemsize).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, count: int, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, count * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, count).T).view(kind).ravel()


def _dealt(part: np.ndarray, row: np.ndarray, records: np.ndarray, ids: np.ndarray, hashes: np.ndarray, told: bool) -> list[tuple]:
    """Rows to exchange: per part the records in order of their texts, with the texts and how many each has."""
    if not len(part):
        return []
    order = _in_order(part, row)
    part, row, records = part[order], row[order], records[order]
    edges = np.append(np.flatnonzero(_changes(part)), len(part))
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        first = np.flatnonzero(_changes(row[lo:hi]))
        who = row[lo:hi][first]
        out.append((int(part[lo]), told, ids[who].tobytes(), hashes[who].tobytes(),
                    np.diff(np.append(first, hi - lo)).astype("<i4").tobytes(), _packed(records[lo:hi])))
    return out


_COLUMNS = ("part", "told", "ids", "hashes", "counts", "records")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=_COLUMNS)


def _slot(ids: np.ndarray, hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part that gathers the answers to a text."""
    return (_pair(ids.view(np.uint64), hashes.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _questions(part: np.ndarray, row: np.ndarray, records: np.ndarray, ids: np.ndarray, hashes: np.ndarray,
               told: tuple[np.ndarray, np.ndarray], parts: int) -> pa.RecordBatch:
    """Questions to ranges, and answers known already (``told``: texts, answers), which take the way of the others."""
    known, answers = told
    return _batch(_dealt(part, row, records, ids, hashes, False)
                  + _dealt(_slot(ids[known], hashes[known], parts), known, answers, ids, hashes, True))


def _held(rows: list[dict], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, hashes, counts, records)`` of exchanged rows: texts, records per text, and the records end to end."""
    ids, hashes, counts = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in
                           (("ids", "<i8"), ("hashes", "<i8"), ("counts", "<i4")))
    records = [_unpacked(r["records"], int(np.frombuffer(r["counts"], "<i4").sum()), kind) for r in rows]
    return ids, hashes, counts, np.concatenate(records)


def _answered(asked: DataFrame, kind: np.dtype, reply: np.dtype, decide: Callable, merge: Callable, parts: int) -> DataFrame:
    """``(_id, _hash, _records)``: answers per text.

    ``decide(ids, records)`` sees all questions of a range and gives the numbers of those it answers, and the answers;
    ``merge`` makes the final records of all answers to one text.
    """
    def ranged(table: pa.Table) -> pa.Table:
        told = table.filter(table.column("told"))  # lies in the slot it goes to
        open_rows = table.filter(pa.compute.invert(table.column("told"))).to_pylist()
        rows = []
        if open_rows:
            ids, hashes, counts, records = _held(open_rows, kind)
            del open_rows
            text = np.repeat(np.arange(len(ids)), counts)
            which, answers = decide(ids[text], records)
            rows = _dealt(_slot(ids, hashes, parts)[text[which]], text[which], answers, ids, hashes, True)
        return pa.concat_tables([told, pa.Table.from_batches([_batch(rows)]).cast(told.schema)])

    def gathered(table: pa.Table) -> pa.Table:
        ids, hashes, counts, records = _held(table.to_pylist(), reply)
        order = np.lexsort((hashes, ids))
        edges = np.append(np.flatnonzero(_changes(ids[order], hashes[order])), len(order))
        sizes = counts[order].astype(np.int64)
        ends = np.cumsum(sizes)
        begins = (np.cumsum(counts, dtype=np.int64) - counts)[order]
        records = records[np.arange(len(records)) + np.repeat(begins - ends + sizes, sizes)]
        upto = np.concatenate([[0], ends])[edges].tolist()
        merged = [merge(records[lo:hi]).tobytes() for lo, hi in zip(upto[:-1], upto[1:])]
        first = order[edges[:-1]]
        return pa.table([pa.array(ids[first]), pa.array(hashes[first]), pa.array(merged, pa.binary())],
                        names=["_id", "_hash", "_records"])

    replies = asked.groupBy("part").applyInArrow(ranged, _EXCHANGED)
    return replies.groupBy("part").applyInArrow(gathered, _FOUND)


def _range(names: np.ndarray, parts: int) -> np.ndarray:
    """The range a name lies in, of ranges of equal width."""
    return ((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _first_ids(order: np.ndarray, new: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per sorted record the smallest id of its group."""
    return np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]


def _groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, new)`` of records by name."""
    order = np.argsort(a)
    if ((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])).any():
        order = np.lexsort((b, a))
    return order, _changes(a[order], b[order])


def _in_several(ids: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least names that stand in more than one document."""
    key = records["hi"].astype(np.uint64) << np.uint64(32) | records["lo"]
    order = np.argsort(key)
    new = _changes(key[order])
    heads = np.flatnonzero(new)
    several = np.minimum.reduceat(ids[order], heads) != np.maximum.reduceat(ids[order], heads)
    which = order[several[np.cumsum(new) - 1]]
    return which, records[which]


def _earlier_runs(ids: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that a document with a smaller id holds too."""
    order, new = _groups(records["a"], records["b"])
    which = order[ids[order] > _first_ids(order, new, ids)]
    return which, _spans(records["at"][which], records["at"][which] + records["size"][which] - np.uint32(1))


def _earlier_windows(ids: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows at shift 0, 1 and 2 of sorted suffixes that a document with a smaller id holds too."""
    order, new = _groups(records["a"], records["b"])
    heads = np.flatnonzero(new)
    shared = np.minimum.reduceat(ids[order], heads) != np.maximum.reduceat(ids[order], heads)
    group = np.cumsum(new) - 1
    kept = shared[group]  # a suffix that no other document shares is done
    order, group = order[kept], group[kept].astype(np.uint64)
    valid, context, at, ids = records["valid"][order], records["context"][order], records["at"][order], ids[order]
    found, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for shift in range(3):
        rows = np.flatnonzero(valid >> shift & 1)
        if not len(rows):
            continue
        key = group[rows] << np.uint64(16) | (context[rows] >> np.uint32(8 * shift) & np.uint32(0xFFFF))
        inner = np.argsort(key)
        later = ids[rows[inner]] > _first_ids(inner, _changes(key[inner]), ids[rows])
        which = rows[inner[later]]
        found.append(order[which])
        places.append(at[which] - np.uint32(shift))
    place = np.concatenate(places)
    return np.concatenate(found), _spans(place, place)


def _spans(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), _SPAN)
    out["at"], out["to"] = at, to
    return out


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans of windows in order, those that meet as one; ``AGAIN`` stays apart, last."""
    spans = spans[np.argsort(spans["at"], kind="stable")]
    until = np.maximum.accumulate(spans["to"].astype(np.int64))
    new = np.ones(len(spans), bool)
    new[1:] = (spans["at"][1:] > until[:-1] + 1) | ((spans["at"][1:] == AGAIN) & (until[:-1] != AGAIN))
    heads = np.flatnonzero(new)
    return _spans(spans["at"][heads], until[np.append(heads[1:], len(spans)) - 1])


def _distinct(records: np.ndarray) -> np.ndarray:
    return np.unique(records)


# ---- the passes over texts ----

def _rebatched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together up to ``BATCH`` bytes, so that more of what repeats is met in one, in order of (id, hash)."""
    held: list[pa.RecordBatch] = []

    def together() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        held.clear()
        if table.num_rows:
            yield table.sort_by([("_id", "ascending"), ("_hash", "ascending")]).combine_chunks().to_batches()[0]

    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BATCH:
            yield from together()
    if held:
        yield from together()


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)).astype(np.int64)


def _first_and_later(order: np.ndarray, new: np.ndarray, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records in order of key, then text: those to ask for, those whose document comes after their key's first, and
    those that repeat a record of their own text."""
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = ids[row[order]] > ids[row[order[head]]]
    again = ~new & ~_changes(row[order])
    return order[~later & ~again], order[later], order[~later & again]


def _groups_of(batch: pa.RecordBatch, cut: bool) -> Iterator[list[tuple[int, int, bytes]]]:
    return _cut_parts(batch) if cut else parts_of((i, t.as_py()) for i, t in enumerate(batch.column(2)))


def _ask_names(parts: int, cut: bool):
    """The least names of each text, those of one batch once: of whole texts, then longer ones of the parts cut of them."""
    name_of, gram = (long_grams, LONG_GRAM) if cut else (grams, GRAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rebatched(batches):
            ids, hashes = _keys(batch)
            for group in _groups_of(batch, cut):
                pieces = Pieces(group)
                start, _, name = pieces.runs(name_of(pieces.data), gram)
                row = pieces.row[pieces.part(start)]
                name = name >> np.uint64(24) << np.uint64(24)
                order = _sorted_by(name)
                order = order[_changes(name[order], row[order])]
                name, row = name[order], row[order]
                new = _changes(name)
                records = np.empty(len(name), _SEEN)
                records["lo"], records["hi"] = name >> np.uint64(24) & np.uint64(0xFFFFFFFF), name >> np.uint64(56)
                # in two documents of this batch: known to all of them, and asked for others by the first
                head = np.flatnonzero(new)
                last = np.append(head[1:], len(name)) - 1
                known = (ids[row[head]] != ids[row[last]])[np.cumsum(new) - 1]
                yield _questions(_range(name[new], parts), row[new], records[new], ids, hashes, (row[known], records[known]), parts)

    return run


_CANDIDATES = "_id bigint, _hash bigint, _bytes binary, _starts binary, _sizes binary"
# Candidates are looked up in a table of bits: one that is hit by chance costs work and changes nothing.
_TABLE_BITS = 23


def _cut_candidates(cut: bool):
    """Of each text the parts whose windows have a least name that stands elsewhere, with two bytes on either side.

    Cut from parts of texts, so two may overlap or meet; windows and suffixes in both are asked for twice, which changes nothing.
    """
    name_of, gram = (long_grams, LONG_GRAM) if cut else (grams, GRAM)
    mask = np.uint64((1 << _TABLE_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rebatched(batches):
            ids, hashes = _keys(batch)
            known = [np.frombuffer(r.as_py(), _SEEN) for r in batch.column(batch.num_columns - 1)]
            for group in _groups_of(batch, cut):
                pieces = Pieces(group)
                start, size, name = pieces.runs(name_of(pieces.data), gram)
                part = pieces.part(start)
                used = np.unique(pieces.row)
                flat = np.concatenate([known[r] for r in used])
                wanted = flat["hi"].astype(np.uint64) << np.uint64(32) | flat["lo"]
                table = np.zeros(1 << _TABLE_BITS, bool)
                table[_pair(wanted, np.repeat(used, [len(known[r]) for r in used]).astype(np.uint64)) & mask] = True
                hit = np.flatnonzero(table[_pair(name >> np.uint64(24), pieces.row[part].astype(np.uint64)) & mask])
                if not len(hit):
                    continue
                first, last, part = start[hit], start[hit] + size[hit] - 1, part[hit]
                new = np.ones(len(hit), bool)
                new[1:] = (first[1:] != last[:-1] + 1) | (part[1:] != part[:-1])
                head = np.flatnonzero(new)
                first, last, part = first[head], last[np.append(head[1:], len(hit)) - 1], part[head]
                begin = np.maximum(first - 2, pieces.at[part])
                stop = np.minimum(last + WIDTH + 2, pieces.at[part + 1])
                row, place = pieces.row[part], pieces.places(begin, part)
                edges = np.append(np.flatnonzero(_changes(row)), len(row))
                view = pieces.data.tobytes()
                out = [(b"".join(view[a:b] for a, b in zip(begin[lo:hi].tolist(), stop[lo:hi].tolist())), place[lo:hi].astype("<i8").tobytes(),
                        (stop - begin)[lo:hi].astype("<i4").tobytes()) for lo, hi in zip(edges[:-1], edges[1:])]
                who = row[edges[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(hashes[who]),
                                                  *(pa.array([o[i] for o in out], pa.binary()) for i in range(3))],
                                                 names=["_id", "_hash", "_bytes", "_starts", "_sizes"])

    return run


def _cut_parts(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, bytes]]]:
    """The parts that :func:`_cut_candidates` has written, in batches."""
    held, size = [], 0
    for row, (body, starts, sizes) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))):
        at = 0
        for start, length in zip(np.frombuffer(starts, "<i8").tolist(), np.frombuffer(sizes, "<i4").tolist()):
            held.append((row, start, body[at:at + length]))
            at += length
            size += length
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _again(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that ask once for what they hold several times."""
    rows = np.unique(rows)
    mark = np.full(len(rows), AGAIN, np.uint32)
    return rows, _spans(mark, mark)


def _ask_runs(parts: int):
    """A fingerprint per run of windows with one least name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rebatched(batches):
            ids, hashes = _keys(batch)
            for group in _cut_parts(batch):
                pieces = Pieces(group)
                nine = nines(pieces.data)
                names, others = _triple(nine, 9, 13), _triple(nine, 9, 17)
                start, size, _ = pieces.runs(names)
                part, last, beyond = pieces.part(start), start + size - 1, WIDTH - GRAM
                a, b = (_pair(_pair(prints(n, start, start + beyond), prints(n, last, last + beyond)), size.astype(np.uint64))
                        for n in (names, others))
                row = pieces.row[part]
                records = np.empty(len(start), _RUN)
                records["a"], records["b"] = a, b >> np.uint64(32)
                records["at"], records["size"] = pieces.places(start, part), size
                order = _sorted_by(a)
                new = _changes(a[order], records["b"][order])
                asked, later, _ = _first_and_later(order, new, row, ids)  # the last pass asks for what repeats in a text
                at = records["at"][later]
                yield _questions(_range(a[asked], parts), row[asked], records[asked], ids, hashes,
                                 (row[later], _spans(at, at + records["size"][later] - np.uint32(1))), parts)

    return run


def _open_windows(pieces: Pieces, settled: list[np.ndarray]) -> np.ndarray:
    """Places where windows begin that no span of their text settles."""
    is_open = np.zeros(len(pieces.data), bool)
    whole = pieces.whole(WIDTH)
    is_open[:len(whole)] = whole
    for row, lo, offset, upto in zip(pieces.row.tolist(), pieces.at[:-1].tolist(), pieces.offset.tolist(), pieces.at[1:].tolist()):
        spans = settled[row]
        if len(spans):
            upto += offset - lo
            for at, to in spans[np.searchsorted(spans["to"], offset):np.searchsorted(spans["at"], upto)].tolist():
                is_open[lo + max(at - offset, 0):lo + min(to + 1, upto) - offset] = False
    return is_open


def _ask_suffixes(parts: int):
    """Sampled suffixes beside windows that are not settled, with two bytes on either side of their prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rebatched(batches):
            ids, hashes = _keys(batch)
            settled = [np.frombuffer(r.as_py() or b"", _SPAN) for r in batch.column(5)]
            for group in _cut_parts(batch):
                pieces = Pieces(group)
                data, end = pieces.data, len(pieces.data)
                is_open = _open_windows(pieces, settled)
                beside = is_open.copy()
                beside[1:] |= is_open[:-1]
                beside[2:] |= is_open[:-2]
                whole = pieces.whole(PREFIX)
                at = np.flatnonzero(beside[:len(whole)] & whole)
                part = pieces.part(at)
                place = pieces.places(at, part)
                sampled = place % 3 != 0
                at, part, place = at[sampled], part[sampled], place[sampled]
                if not len(at):
                    continue
                left, right = at - pieces.at[part], pieces.at[part + 1] - at - PREFIX
                records = np.empty(len(at), _SUFFIX)
                records["valid"] = (right >= 2) | ((left >= 1) & (right >= 1)) << 1 | (left >= 2) << 2
                records["at"] = place
                context = np.zeros(len(at), np.uint32)
                for step, ok, bits in ((-2, left >= 2, 24), (-1, left >= 1, 16), (PREFIX, right >= 1, 8), (PREFIX + 1, right >= 2, 0)):
                    context |= np.where(ok, data[np.clip(at + step, 0, end - 1)], 0).astype(np.uint32) << np.uint32(bits)
                records["context"] = context
                nine = nines(data)
                a = prints(_triple(nine, 9, 13), at, at + PREFIX - GRAM)
                records["a"], records["b"] = a, prints(_triple(nine, 9, 17), at, at + PREFIX - GRAM) >> np.uint64(32)
                row = pieces.row[part]
                order = _sorted_by(_pair(a, context.astype(np.uint64) | records["valid"].astype(np.uint64) << np.uint64(32)))
                new = _changes(*(records[k][order] for k in ("a", "b", "context", "valid")))
                asked, later, again = _first_and_later(order, new, row, ids)
                known, answers = zip(_again(row[again]), *(
                    (row[which], _spans(place[which] - shift, place[which] - shift)) for shift, which in
                    ((shift, later[(records["valid"][later] >> shift & 1).astype(bool)]) for shift in range(3))))
                yield _questions(_range(a[asked], parts), row[asked], records[asked], ids, hashes,
                                 (np.concatenate(known), np.concatenate(answers)), parts)

    return run


def _window_names(body: bytes) -> np.ndarray:
    names = grams(np.frombuffer(body, np.uint8))
    return _pair(names[:len(body) - WIDTH + 1], names[WIDTH - GRAM:])


def with_equals(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Windows of ``spans`` and all others of the text that equal one of them, in blocks of a long text."""
    starts = [(begin, min(to + 1, begin + BATCH)) for at, to in spans.tolist() for begin in range(at, to + 1, BATCH)]
    marked = np.unique(np.concatenate([_window_names(text[a:b + WIDTH - 1]) for a, b in starts]))
    found = [np.flatnonzero(np.isin(_window_names(text[a:a + BATCH + WIDTH - 1]), marked)) + a
             for a in range(0, len(text) - WIDTH + 1, BATCH)]
    place = np.concatenate(found).astype(np.uint32)
    return _merged(_spans(place, place))


def covered(text: bytes, spans: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges that the windows of ``spans`` cover, as maximal (start, end)."""
    if spans["at"][-1] == AGAIN:
        spans = spans[:-1]
        spans = with_equals(text, spans) if len(spans) else spans
    out: list[tuple[int, int]] = []
    for at, to in spans.tolist():
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], to + WIDTH)
        else:
            out.append((at, to + WIDTH))
    return out


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last pass: ``(spans, kept)`` behind the columns carried along."""
    for batch in batches:
        width = batch.num_columns - 2
        spans, kept = [], []
        for text, marks in zip(batch.column(width), batch.column(width + 1)):
            text, marks = text.as_py() or b"", marks.as_py()
            cut = covered(text, _merged(np.frombuffer(marks, _SPAN))) if marks else []
            spans.append(cut)
            at, left = 0, []
            for start, end in cut:
                left.append(text[at:start])
                at = end
            kept.append(b"".join([*left, text[at:]]) if cut else text)
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(width)),
             pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pair)), pa.array(kept, pa.binary())],
            names=[*batch.schema.names[:width], "spans", "kept"])


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, spans, kept)`` per row: byte ranges that repeat an earlier document, and the bytes left.

    A byte goes when a string of 50 bytes over it also starts in a document with a smaller id; strings are those of the whole
    texts as they came, in UTF-8. Five passes over texts or what is left of them put questions to ranges of names; the
    answers come back per text. No task meets more than a range of names, a batch of texts or the answers to a share of texts,
    and a string that stands everywhere leaves each batch once. What is broadcast is checked for its size.

    Null and empty texts, and those under 50 bytes, lose nothing. Rows of one id do not repeat each other; equal rows lose
    the same. A null id is neither smaller nor larger than any: such rows lose nothing and take nothing. An empty table gives an
    empty result, other columns are ignored.
    """
    body = text_of(text).cast("binary")
    rows = docs.select(F.col(key).cast("bigint").alias("_id"), F.xxhash64(text_of(text)).alias("_hash"), body.alias("_body"))
    known = rows.filter(F.col("_id").isNotNull() & (F.octet_length("_body") >= WIDTH))
    total = known.agg(F.sum(F.octet_length("_body"))).head()[0] or 0
    few, some, parts = (int(total // size) + 1 for size in (NAME_RANGE, RUN_RANGE, SUFFIX_RANGE))

    def join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_records")
        return left.join(right, (F.col("_id") == F.col("_i")) & (F.col("_hash") == F.col("_h")), how).drop("_i", "_h")

    parted = known
    for cut in (False, True):  # not broadcast: the names of all texts grow with them
        names = _answered(parted.mapInArrow(_ask_names(few, cut), _EXCHANGED), _SEEN, _SEEN, _in_several, _distinct, few)
        parted = written(join(parted, names, "inner").mapInArrow(_cut_candidates(cut), _CANDIDATES), "candidates")
    runs = _answered(parted.mapInArrow(_ask_runs(some), _EXCHANGED), _RUN, _SPAN, _earlier_runs, _merged, some)
    runs = written(runs, "runs")
    asked = join(parted, runs, "left").mapInArrow(_ask_suffixes(parts), _EXCHANGED)
    suffixes = _answered(asked, _SUFFIX, _SPAN, _earlier_windows, _merged, parts)
    marks = runs.unionByName(suffixes).groupBy("_id", "_hash").agg(F.collect_list("_records").alias("_all"))
    marks = marks.select("_id", "_hash", F.expr("aggregate(_all, X'', (a, b) -> concat(a, b))").alias("_records"))
    out = docs.select(F.col(key), F.col(key).cast("bigint").alias("_id"), F.xxhash64(text_of(text)).alias("_hash"),
                      F.octet_length(body).cast("bigint").alias("n_bytes"), body.alias("_body"))
    kind = docs.schema[key].dataType.simpleString()
    return (join(out, small_side(marks, "marks"), "left").select(key, "n_bytes", "_body", "_records")
            .mapInArrow(_cut_texts, f"{key} {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"))
