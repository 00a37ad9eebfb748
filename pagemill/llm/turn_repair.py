"""Conversation structure repair: cheapest edits to alternating turns, streamed over secondary-sorted rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# Blanks, closing marks, and what an edit costs.
BLANKS = " \t\n\x0b\x0c\r"
CLOSING = ".!?"
REROLE, DELETE, INSERT, OPEN_END = 3, 4, 3, 3
# Pointers of longer conversations leave the task in pieces of this many rows (four bytes each).
SPILL_ROWS = 1 << 18

# States are what the kept roles spell so far: nothing, a system turn, a user turn last, an assistant turn last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NAMES = {_USER: b"user:", _ASSISTANT: b"assistant:"}
_FOLLOWS = (_USER, _USER, _ASSISTANT, _USER)
_KEEPS = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_LETTERS = "DIKR"
_SOUND, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_DEAD = 255
# What any state can do, any other does for at most this much more: two inserts, and a system turn deleted instead of kept.
_REACH = 2 * INSERT + DELETE


@lru_cache(maxsize=None)
def _options(initial: str, fault: int) -> tuple:
    """``(from, to, cost, inserts, letter, state before the row)`` of every way over a row: inserts, then one edit of it.

    After two inserts the state is one that fewer reach, so more are never cheapest.
    """
    found = []
    more = OPEN_END if fault == _TRUNCATED else 0
    for source in range(4):
        state = source
        for inserts in range(3):
            found.append((source, state, INSERT * inserts + DELETE, inserts, "D", state))
            if fault not in (_BLANK, _DUPLICATE):
                if (state, initial) in _KEEPS:
                    found.append((source, _KEEPS[state, initial], INSERT * inserts + more, inserts, "K", state))
                found.append((source, _FOLLOWS[state], INSERT * inserts + REROLE + more, inserts, "R", state))
            state = _FOLLOWS[state]
    return tuple(found)


@lru_cache(maxsize=1 << 16)
def _step(costs: tuple, ranks: tuple, initial: str, fault: int) -> tuple:
    """One row of the dynamic programme: ``(added, costs, ranks, pointers, choices)``.

    ``costs`` are above the cheapest state's, None for a state out of reach; ``ranks`` order the states by their edits
    so far as text. Two states' edits differ before either ends, for both end with the edit of the same row; so
    the rank decides whatever follows. What can come of a row is finite, and remembered.
    """
    best: dict[int, tuple] = {}
    for source, target, cost, inserts, letter, before in _options(initial, fault):
        if costs[source] is None:
            continue
        key = (costs[source] + cost, ranks[source], "I" * inserts + letter)
        if target not in best or key < best[target][0]:
            best[target] = (key, source, inserts, letter, before)
    least = min(b[0][0] for b in best.values())
    best = {t: b for t, b in best.items() if b[0][0] <= least + _REACH}
    order = sorted(best, key=lambda t: best[t][0][1:])
    return (least, tuple(best[t][0][0] - least if t in best else None for t in range(4)),
            tuple(order.index(t) if t in best else 0 for t in range(4)),
            bytes(best[t][1] | best[t][2] << 2 | _LETTERS.index(best[t][3]) << 4 if t in best else _DEAD for t in range(4)),
            tuple((t, *best[t][1:]) for t in best))


def _traced(pointers: bytes, state: int) -> tuple[str, int]:
    """The edits that lead over these rows into ``state``, and the state before them."""
    edits = []
    for at in range(len(pointers) - 4, -1, -4):
        pointer = pointers[at + state]
        edits.append(_LETTERS[pointer >> 4] + "I" * (pointer >> 2 & 3))
        state = pointer & 3
    return "".join(edits)[::-1], state


class _Conversation:
    """What is carried from row to row: costs, ranks, one running hash per state, counts and the latest pointers.

    Its size does not depend on the conversation's length: full pointers are handed out as pieces.
    """

    def __init__(self, key):
        self.key, self.cost, self.costs, self.ranks = key, 0, (0, None, None, None), (0, 0, 0, 0)
        self.hashes = [hashlib.sha256(), None, None, None]
        self.pointers, self.pieces = bytearray(), 0
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.faults[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high  # turns come sorted
            self.high = turn
        added, self.costs, self.ranks, pointers, choices = _step(self.costs, self.ranks, initial, fault)
        self.cost += added
        self.pointers += pointers
        body = None
        hashes = [None] * 4
        for target, source, inserts, letter, before in choices:
            digest = self.hashes[source].copy()
            state = source
            for _ in range(inserts):
                digest.update((b"\n" if state else b"") + _NAMES[_FOLLOWS[state]])
                state = _FOLLOWS[state]
            if letter != "D":
                body = text.encode("utf-8", "surrogatepass") if body is None else body
                name = role.encode("utf-8", "surrogatepass") + b":" if letter == "K" else _NAMES[target]
                digest.update((b"\n" if before else b"") + name)
                digest.update(body)
            hashes[target] = digest
        self.hashes = hashes

    def end(self) -> tuple[int, int, str, str]:
        """``(final state, cost, trailing inserts, digest)`` of the cheapest way to end."""
        ways = []
        for state in range(4):
            if self.costs[state] is not None:
                inserts = {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}[state]
                ways.append((self.costs[state] + INSERT * inserts, self.ranks[state], "I" * inserts, state))
        cost, _, tail, state = min(ways)
        digest, at = self.hashes[state].copy(), state
        for _ in tail:
            digest.update((b"\n" if at else b"") + _NAMES[_FOLLOWS[at]])
            at = _FOLLOWS[at]
        return state, self.cost + cost, tail, digest.hexdigest()


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_STREAMED = "_key string, " + ", ".join(f"{c} bigint" for c in _RESULT) + (
    ", audit string, repaired_sha256 string, _piece bigint, _pointers binary, _state int, _tail string")


def _repaired(batches: Iterator[pd.DataFrame], spill_rows: int) -> Iterator[pd.DataFrame]:
    """One row per conversation, and the pieces of pointers of those longer than ``spill_rows``."""
    columns = [c.split()[0] for c in _STREAMED.split(", ")]
    state: _Conversation | None = None

    def piece(c: _Conversation, final: int | None = None, tail: str | None = None) -> tuple:
        row = (c.key, *[None] * 8, c.pieces, bytes(c.pointers), final, tail)
        c.pointers, c.pieces = bytearray(), c.pieces + 1
        return row

    def closed(c: _Conversation) -> list[tuple]:
        final, cost, tail, digest = c.end()
        gaps = 0 if c.low is None else c.high - c.low + 1 - c.turns
        counts = (gaps, c.faults[_BLANK], c.faults[_DUPLICATE], c.faults[_TRUNCATED], c.illegal, cost)
        if not c.pieces:
            return [(c.key, *counts, _traced(c.pointers, final)[0] + tail, digest, None, None, None, None)]
        return [piece(c, final, tail), (c.key, *counts, None, digest, None, None, None, None)]

    for batch in batches:
        out = []
        for key, turn, known, role, text, fault, dropped in zip(*(batch[c].tolist() for c in batch.columns)):
            if state is None or state.key != key:
                out += closed(state) if state else []
                state = _Conversation(key)
            if dropped:
                continue
            state.add(turn if known else None, role, text, fault)
            if len(state.pointers) >= 4 * spill_rows:
                out.append(piece(state))
        if out:
            yield pd.DataFrame(out, columns=columns)
    if state:
        yield pd.DataFrame(closed(state), columns=columns)


def _traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of each piece, pieces of a conversation last first; only the state goes from one to the next."""
    state = 0
    for batch in batches:
        out = []
        for key, number, pointers, final, tail in zip(*(batch[c].tolist() for c in batch.columns)):
            state = state if tail is None else int(final)
            edits, state = _traced(pointers, state)
            out.append((key, number, edits + (tail or "")))
        yield pd.DataFrame(out, columns=["_key", "_piece", "_edits"])


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(key, turn, role, text, _copy, _dropped)``: turns with faults dealt by a checksum of conversation and turn.

    A null counts as one space. A dropped row stays, marked, so that its conversation is not forgotten.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(key), F.lit(":"), spaced(turn)).cast("binary")) % 20
    rows = turns.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"),
                        spaced(text).alias("text"), kind.alias("_kind"))
    body = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    return (rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    body.alias("text"), "_copy", (F.col("_kind") == 0).alias("_dropped")))


def _fault(again: Column) -> Column:
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    return (F.when(seen == "", _BLANK).when(again, _DUPLICATE)
            .when(~F.substring(seen, -1, 1).isin(*CLOSING), _TRUNCATED).otherwise(_SOUND))


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copy: str | None = None, dropped: str | None = None, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``: one row per conversation.

    One shuffle by conversation; inside it rows are sorted by (role, text) to tell repeats and by turn for the stream, in
    Spark's own sorts, which spill. ``mapInPandas`` then carries the state of the programme across Arrow batches: four
    costs, four running hashes, and pointers of four bytes a row. Pointers of long conversations leave the task as rows of
    a written table and are traced back piece by piece, last first, so memory is bounded whatever the length; only
    the audit itself is as long as its conversation.

    ``copy`` names a column that orders equal rows, ``dropped`` one that marks rows which only keep their conversation
    from being forgotten. Nulls in role or text count as one
    space; null turns come first and are in no gap; a null key is a conversation. Rows of one turn are ordered by role
    and text, so their order in the table is of no account; repeated rows are duplicates. An empty table gives an empty
    result, other columns are ignored.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(key).cast("string").alias("_key"), F.col(turn).cast("bigint").alias("_turn"), spaced(role).alias("role"),
        spaced(text).alias("text"), (F.col(copy) if copy else F.lit(0)).alias("_copy"),
        (F.col(dropped) if dropped else F.lit(False)).alias("_dropped")).repartition("_key")
    alike = Window.partitionBy("_key", "_dropped", "role", F.sha2("text", 256)).orderBy(F.col("_turn").asc_nulls_first(), "_copy")
    rows = (rows.withColumn("_again", F.row_number().over(alike) > 1).withColumn("_fault", _fault(F.col("_again")))
            .sortWithinPartitions("_key", F.col("_turn").asc_nulls_first(), "role", "text", "_copy")
            .select("_key", F.coalesce("_turn", F.lit(0)).alias("_turn"), F.col("_turn").isNotNull().alias("_known"), "role",
                    "text", "_fault", "_dropped"))
    streamed = written(rows.mapInPandas(lambda batches: _repaired(batches, spill_rows), _STREAMED), "repaired")
    pieces = (streamed.filter("_piece is not null").select("_key", "_piece", "_pointers", "_state", "_tail")
              .repartition("_key").sortWithinPartitions("_key", F.col("_piece").desc()))
    traced = (pieces.mapInPandas(_traces, "_key string, _piece bigint, _edits string").groupBy("_key")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_edits"))), lambda p: p["_edits"]), "")
                   .alias("_audit")).withColumnRenamed("_key", "_of"))
    whole = streamed.filter("_piece is null")
    return (whole.join(traced, F.col("_key").eqNullSafe(F.col("_of")), "left")
            .select(F.col("_key").cast(turns.schema[key].dataType).alias("conv_id"), *_RESULT,
                    F.coalesce("audit", "_audit").alias("audit"), "repaired_sha256"))
