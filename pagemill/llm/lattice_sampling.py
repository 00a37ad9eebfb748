"""SentencePiece encoding by sampling: Gumbel top-k without replacement over the piece lattice, and decoding."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count as counter, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where the public tokenizers lie on the driver; tasks get the tables below with their function.
TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
# Distinct segmentations per text.
SAMPLES = 2
# The vocabulary is ordered by merges, not by probability: a piece's weight is Zipf's law over its rank, to this power.
ALPHA = 1.0
SEED = 6
# Texts are worked on in groups of about this many characters; neither this nor the next changes any draw.
GROUP_CHARS = 300_000
# Distinct units of so many characters are held between groups.
UNIT_CHARS = 400_000
# Units above this length are weighed and walked one by one, shorter ones all in step.
LONG_UNIT = 256
# A branch whose log mass lies this far below its text's is beyond what a double can draw.
NEGLIGIBLE = 60.0

# The blank of the vocabulary and the stand-in for a text's own U+2581.
_BLANK, _OWN_BLANK = 0x2581, 0x110001
_UNIT = re.compile(r" *[^ ]+| +")
_TOP = np.float64(2.0 ** -53)


@dataclass
class Vocabulary:
    """The pieces as a trie in a double array, and the piece a state ends.

    The next state of ``state`` by a character is ``base[state]`` plus the character's class, if ``parent`` names ``state``
    there. Characters of no piece are of the last class, which leads nowhere; so are all beyond the table's end.
    """

    class_of: np.ndarray
    base: np.ndarray
    parent: np.ndarray
    piece_of: np.ndarray
    weight_of: np.ndarray
    floor: float
    first_byte: int
    texts: list[bytes]


def load_vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    """Read the model on the driver; what tasks need is bounded by the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    first_byte = pieces.index("<0x00>")
    numbers = [n for n in range(size) if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n) or model.is_unused(n))]
    class_of, base, parent, piece_of = _double_array({n: pieces[n] for n in numbers})
    rank = np.maximum(np.arange(size) - first_byte - 255, 1)
    weight_of = -alpha * np.log(rank + 1.0)
    texts = [bytes([i - first_byte]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i)
             else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Vocabulary(class_of, base, parent, piece_of, weight_of, float(weight_of.min()) - 1.0, first_byte, texts)


def _double_array(pieces: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(class_of, base, parent, piece_of)`` of the trie of the pieces; states of many children are placed first."""
    often = Counter(chain.from_iterable(pieces.values()))
    none = len(often)
    class_of = np.full(max(map(ord, often)) + 2, none, np.int32)
    class_of[[ord(c) for c, _ in often.most_common()]] = np.arange(none)  # common ones close together
    children: list[dict[int, int]] = [{}]
    ends = {}
    for number, piece in pieces.items():
        node = 0
        for char in class_of[list(map(ord, piece))].tolist():
            if char not in children[node]:
                children[node][char] = len(children)
                children.append({})
            node = children[node][char]
        ends[node] = number
    # a node's children lie at its base plus their classes, the root's from 1 on: slot 0 is its own
    free = np.ones(len(children) * 4 + 2 * none + 2, bool)
    free[:none + 1] = False
    base_of, slot_of, low = [1] + [0] * (len(children) - 1), [0] * len(children), none + 1
    for node in sorted((n for n, c in enumerate(children) if n == 0 or len(c) > 1), key=lambda n: (n > 0, -len(children[n]))):
        if node:
            classes = np.fromiter(children[node], np.int64, len(children[node]))
            width, spots = 64, np.empty(0, np.int64)
            while not len(spots):
                if low + width + none >= len(free):
                    free = np.append(free, np.ones(len(free), bool))
                spots = low + np.flatnonzero(free[low:low + width])
                spots = spots[free[spots[:, None] + (classes - classes.min())].all(axis=1)]
                low += 0 if len(spots) else width
            base_of[node] = int(spots[0] - classes.min())
            free[base_of[node] + classes] = False
            low = int(spots[0])  # gaps are left to states of one child
        for char, child in children[node].items():
            slot_of[child] = base_of[node] + char
    only = [n for n, c in enumerate(children) if n and len(c) == 1]
    for node, spot in zip(only, np.flatnonzero(np.append(free, np.ones(len(only), bool))).tolist()):
        (char, child), = children[node].items()
        base_of[node], slot_of[child] = spot - char, spot
    slots = max(max(base_of) + none, max(slot_of)) + 1
    base, parent, piece_of = np.zeros(slots, np.int32), np.full(slots, -1, np.int32), np.full(slots, -1, np.int32)
    base[slot_of] = base_of
    for node, found in enumerate(children):
        for child in found.values():
            parent[slot_of[child]] = slot_of[node]
    piece_of[[slot_of[n] for n in ends]] = list(ends.values())
    return class_of, base, parent, piece_of


class Lattice:
    """Edges of distinct units, grouped by start, longest first.

    ``log`` is the log share of a start's mass that takes an edge, ``until`` the running share up to and with it.
    Units stay from group to group, so a unit is weighed once, until ``unit_chars`` are held and all start anew.
    """

    def __init__(self, vocabulary: Vocabulary, unit_chars: int = UNIT_CHARS):
        self.vocabulary, self.unit_chars, self.room = vocabulary, unit_chars, {}
        self.clear()

    def clear(self) -> None:
        """Hold nothing; the arrays' room stays."""
        self.numbers = defaultdict(counter().__next__)  # a unit asked for the first time gets the next number
        self.first, self.start, self.end, self.piece = (np.zeros(n, np.int32) for n in (1, 0, 0, 0))
        self.log, self.until, self.alone = np.zeros(0), np.zeros(0, np.float32), np.zeros(0, bool)
        self.chars = np.zeros(0, np.int32)
        self.unit_start, self.unit_end = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _extend(self, name: str, values: np.ndarray) -> None:
        """Append in place; an array out of room moves to one of twice its size, so old edges are seldom copied."""
        held = getattr(self, name)
        size, room = len(held) + len(values), self.room.get(name)
        if room is None or len(room) < size:
            room = self.room[name] = np.empty(max(size, 2 * len(held)), held.dtype)
        if held.base is not room:
            room[:len(held)] = held
        room[len(held):size] = values
        setattr(self, name, room[:size])

    def start_of(self, edges):
        """The place where an edge, or each of some edges, begins."""
        return self.start[edges].astype(np.int64)

    def number(self, units: list[list[str]]) -> np.ndarray:
        """The number of each unit of some texts; those not held yet are added."""
        if len(self.chars) > self.unit_chars:
            self.clear()
        held = len(self.numbers)
        codes = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(units)), np.int64, sum(map(len, units)))
        if len(self.numbers) > held:
            self._add(list(islice(reversed(self.numbers), len(self.numbers) - held))[::-1])
        return codes

    def _add(self, units: list[str]) -> None:
        """All pieces at all places of the units, weighed by what can follow.

        No piece holds a blank after another character, so a text's lattice has a cut at every unit and each unit
        is weighed alone. A character without a piece is an edge of byte pieces (``piece`` is -1).
        """
        vocabulary = self.vocabulary
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1  # a unit is spelled without its first blank
        chars = np.frombuffer((" " + " ".join(units)).encode("utf-32-le", "surrogatepass"), np.int32)
        # only blanks of the text itself are the vocabulary's; its own sign for one has no piece
        chars = np.where(chars == 0x20, _BLANK, np.where(chars == _BLANK, _OWN_BLANK, chars))
        ends = np.cumsum(sizes)
        places = len(chars)
        first, start, end, piece = self._edges(chars, ends - sizes)
        several = np.diff(first)
        weight = np.where(piece >= 0, vocabulary.weight_of[piece], vocabulary.floor)
        # a unit's first place has its sum behind all places, so the end of the unit before, which is the same place, keeps 0
        slot = np.arange(places)
        slot[ends - sizes] = places + 1 + np.arange(len(units))
        after = np.zeros(places + 1 + len(units))
        long = sizes > LONG_UNIT
        distance = np.repeat(ends, sizes) - np.arange(places)
        short = np.flatnonzero(np.repeat(~long, sizes)) if long.any() else np.arange(places)
        self._sums_in_step(short[np.argsort(distance[short].astype(np.uint16), kind="stable")], distance, first, several, end,
                           weight, slot, after)
        for lo, hi in zip((ends - sizes)[long].tolist(), ends[long].tolist()):
            self._sums_one_by_one(lo, hi, first, end, weight, slot, after)
        log = weight
        log += after[end]
        log -= np.repeat(after[slot], several)
        until = self._running(np.exp(log), first, several)
        at, edges = len(self.chars), len(self.end)
        self._extend("first", first[1:] + edges)
        self._extend("start", start + at)
        self._extend("end", end + at)
        self._extend("piece", piece)
        self._extend("log", log)
        self._extend("until", until)
        self._extend("alone", np.repeat(several == 1, several))
        self._extend("chars", chars)
        self._extend("unit_start", ends - sizes + at)
        self._extend("unit_end", ends + at)

    def _edges(self, chars: np.ndarray, unit_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(first, start, end, piece)``: where a place's edges begin, then all pieces at all places, by place, the longest
        first: mostly the likeliest."""
        vocabulary = self.vocabulary
        classes = vocabulary.class_of[np.minimum(chars, len(vocabulary.class_of) - 1)]
        state, place, length = 1 + classes, np.arange(len(chars), dtype=np.int32), 1
        hit = vocabulary.parent[state] == 0
        state, place = state[hit], place[hit]
        # no piece goes on into the next unit
        classes = np.append(classes, vocabulary.class_of[-1])
        classes[unit_start] = vocabulary.class_of[-1]
        several, levels = np.zeros(len(chars), np.int32), []
        while len(place):
            piece = vocabulary.piece_of[state]
            is_piece = np.flatnonzero(piece >= 0)
            at = place[is_piece]
            several[at] += 1
            levels.append((at, at + np.int32(length), piece[is_piece]))
            following = vocabulary.base[state] + classes[place + length]
            hit = np.flatnonzero(vocabulary.parent[following] == state)
            state, place, length = following[hit], place[hit], length + 1
        single = np.zeros(len(chars), bool)
        if levels:
            single[levels[0][0]] = True
        rest = np.flatnonzero(~single).astype(np.int32)
        several[rest] += 1
        levels.insert(0, (rest, rest + np.int32(1), np.full(len(rest), -1, np.int32)))
        first = np.concatenate([[0], np.cumsum(several)])
        end, pieces = np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
        free = first[1:].copy()
        for at, stop, piece in levels:
            free[at] -= 1
            edge = free[at]
            end[edge], pieces[edge] = stop, piece
        return first, np.repeat(np.arange(len(chars), dtype=np.int32), several), end, pieces

    @staticmethod
    def _sums_in_step(order, distance, first, several, end, weight, slot, after) -> None:
        """Backward log sums of short units, all in step: ``order`` has their places by the distance from the unit's end."""
        several = several[order]
        stops = np.cumsum(several)
        heads = stops - several
        edge = np.repeat(first[order] - heads, several) + np.arange(int(several.sum()))
        end, weight, slot = end[edge], weight[edge], slot[order]
        bounds = np.cumsum(np.bincount(distance[order])).tolist()
        for lo, hi in zip(bounds, bounds[1:]):
            if lo == hi:
                continue
            a, b = heads[lo], stops[hi - 1]
            value = weight[a:b] + after[end[a:b]]
            peak = np.maximum.reduceat(value, heads[lo:hi] - a)
            value -= np.repeat(peak, several[lo:hi])
            after[slot[lo:hi]] = peak + np.log(np.add.reduceat(np.exp(value, out=value), heads[lo:hi] - a))

    @staticmethod
    def _sums_one_by_one(lo: int, hi: int, first, end, weight, slot, after) -> None:
        """Backward log sums of one long unit, place by place: steps of one place are too small for arrays."""
        at = first[lo:hi + 1].tolist()
        ends, weights = (end[at[0]:at[-1]] - lo).tolist(), weight[at[0]:at[-1]].tolist()
        sums, base = [0.0] * (hi - lo + 1), at[0]
        for place in range(hi - lo - 1, -1, -1):
            values = [weights[k] + sums[ends[k]] for k in range(at[place] - base, at[place + 1] - base)]
            peak = max(values)
            sums[place] = peak + math.log(sum([math.exp(v - peak) for v in values]))
        after[slot[lo:hi]] = sums[:-1]

    @staticmethod
    def _running(chance: np.ndarray, first: np.ndarray, several: np.ndarray) -> np.ndarray:
        """Per edge the share of its place's edges up to and with it, added up place by place; the last takes the rest."""
        running, at, left = chance.copy(), first[:-1], several
        while True:
            more = left > 1
            at, left = at[more] + 1, left[more] - 1
            if not len(at):
                break
            running[at] += running[at - 1]
        running[first[1:] - 1] = 2.0
        return running.astype(np.float32)


def units_of(text: str) -> list[str]:
    """The text cut before every run of blanks, a blank put in front; each unit without its first blank."""
    if not text:
        return []
    if text[0] == " " or "  " in text:
        return [u[1:] for u in _UNIT.findall(" " + text)]
    return text.split(" ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on seed and counter only, not on what else is drawn."""
    bits = _mix(counter.astype(np.uint64))
    bits ^= seed
    bits = _mix(bits)
    bits >>= np.uint64(11)
    draw = bits.astype(np.float64)
    draw += 0.5
    draw *= _TOP
    return draw


def walk(lattice: Lattice, place: np.ndarray, end: np.ndarray, text_place: np.ndarray, seed: np.ndarray,
         ) -> tuple[np.ndarray, np.ndarray]:
    """Sample a path from every ``place`` to its unit's ``end``: edges in order, and edges per walker.

    Walkers of short units step together, those of long units go one after another. ``text_place`` is the place in the
    text, which with ``seed`` draws the number.
    """
    count = np.zeros(len(place), np.int64)
    active = np.flatnonzero((place < end) & (end - place <= LONG_UNIT))
    here, offset = place.copy(), text_place - place
    alone = {int(w): _walk_alone(lattice, int(place[w]), int(end[w]), int(offset[w]), seed[w]) for w in
             np.flatnonzero(end - place > LONG_UNIT)}
    steps = []
    while len(active):
        at = here[active]
        edge = lattice.first[at]
        draw = uniform(seed[active], offset[active] + at)
        wrong = np.flatnonzero(draw >= lattice.until[edge])
        while len(wrong):
            edge[wrong] += 1
            wrong = wrong[draw[wrong] >= lattice.until[edge[wrong]]]
        steps.append((active, edge))
        here[active] = lattice.end[edge]
        count[active] += 1
        active = active[here[active] < end[active]]
    for who, edges in alone.items():
        count[who] = len(edges)
    begins = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for number, (who, edge) in enumerate(steps):
        out[begins[who] + number] = edge
    for who, edges in alone.items():
        out[begins[who]:begins[who] + len(edges)] = edges
    return out, count


def _walk_alone(lattice: Lattice, place: int, end: int, offset: int, seed: np.uint64) -> list[int]:
    """One walker's edges."""
    first = lattice.first[place:end + 1].tolist()
    base = first[0]
    until, ends = lattice.until[base:first[-1]].tolist(), (lattice.end[base:first[-1]] - place).tolist()
    draws = uniform(np.full(end - place, seed), np.arange(place, end) + offset).tolist()
    at, edges = 0, []
    while at < end - place:
        edge = first[at] - base
        while draws[at] >= until[edge]:
            edge += 1
        edges.append(edge + base)
        at = ends[edge]
    return edges


def _below(mass: np.ndarray, bound: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Gumbel variates of log mass ``mass``, conditioned to lie below ``bound``."""
    with np.errstate(over="ignore"):
        return mass - np.log(-np.log(draw) + np.exp(mass - bound))


def _segment_sums(values: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of a segment's elements before each element, from ``start`` of the segment."""
    run = np.cumsum(values) - values
    at = np.cumsum(sizes) - sizes
    base = np.where(sizes > 0, run[np.minimum(at, max(len(run) - 1, 0))] if len(run) else 0.0, 0.0)
    return run + np.repeat(start - base, sizes)


class _Paths:
    """Fresh steps of one sampled path per text, with the best thing that leaves each of them."""

    def __init__(self, lattice: Lattice, edges: np.ndarray, sizes: np.ndarray, begin: np.ndarray, log: np.ndarray,
                 bound: np.ndarray, seed: np.ndarray):
        self.edges, self.sizes, self.begin = edges, sizes, begin
        self.at = np.cumsum(sizes) - sizes
        step = lattice.log[edges]
        of_text = np.repeat(np.arange(len(sizes)), sizes)
        self.before = _segment_sums(step, sizes, log)
        self.log = log + np.bincount(of_text, step, len(sizes))
        near = np.flatnonzero(self.before > (log - NEGLIGIBLE)[of_text])
        near = near[~lattice.alone[edges[near]]]
        text = of_text[near]
        with np.errstate(divide="ignore"):
            mass = self.before[near] + np.log(np.maximum(-np.expm1(step[near]), 0.0))
        draw = uniform(_mix(seed + np.uint64(77))[text], near - self.at[text] + begin[text])
        self.leave = np.full(len(edges), -np.inf)
        self.leave[near] = np.where(np.isfinite(mass), _below(mass, bound[text], draw), -np.inf)
        self.best = np.full(len(sizes), -np.inf)
        some = np.flatnonzero(sizes > 0)
        if len(some):
            self.best[some] = np.maximum.reduceat(self.leave, self.at[some])

    def refresh(self, text: int) -> None:
        part = self.leave[self.at[text]:self.at[text] + self.sizes[text]]
        self.best[text] = part.max() if len(part) else -np.inf


def sample_group(texts: list[str], keys: np.ndarray, lattice: Lattice, samples: int) -> list[list[tuple]]:
    """Per text up to ``samples`` distinct segmentations: (ids, log probability, perturbed score, inclusion score).

    Perturbed A-star search: every partial segmentation of the search tree carries the largest Gumbel-perturbed log probability
    among its completions. The root's is drawn; a node passes its value on to one child, drawn by mass, and the
    others get Gumbels below it. So the first segmentation is a plain sample; the next leaves the best open branch of
    those before it, and so on, which is exact sampling without replacement. The value of the best branch still
    open is the threshold of the inclusion scores: log of the chance that a segmentation beats it.
    """
    count = len(texts)
    parts = [units_of(t) for t in texts]
    if not any(parts):
        return [[(np.empty(0, np.int32), 0.0, 0.0, 0.0)] for _ in texts]
    codes = lattice.number(parts)
    per_text = np.fromiter(map(len, parts), np.int64, count)
    unit_first = np.cumsum(per_text) - per_text
    of_text = np.repeat(np.arange(count), per_text)
    width = (lattice.unit_end - lattice.unit_start)[codes]
    unit_place = np.cumsum(width) - width
    text_place = unit_place - unit_place[unit_first[of_text]]  # where a unit begins in its text
    seeds = _mix(keys)

    edges, steps = walk(lattice, lattice.unit_start[codes], lattice.unit_end[codes], text_place, seeds[of_text])
    sizes = np.bincount(of_text, steps, count).astype(np.int64)
    top = -np.log(-np.log(uniform(_mix(seeds + np.uint64(1)), np.zeros(count))))
    zero = np.zeros(count)
    paths = [_Paths(lattice, edges, sizes, np.zeros(count, np.int64), zero, top, seeds)]
    whole = [[edges[a:a + n] for a, n in zip(paths[0].at, sizes)]]
    results = [[(whole[0][t], float(paths[0].log[t]), float(top[t]))] for t in range(count)]
    taken: dict[tuple[int, int, int], list[int]] = {}
    last = np.full(count, -np.inf)
    for number in range(1, samples + 1):
        values = np.stack([p.best for p in paths])
        source, score = values.argmax(0), values.max(0)
        if number == samples:
            last = score
            break
        open_texts = np.flatnonzero(score > -np.inf)
        if not len(open_texts):
            break
        fresh_first, log, begin = np.zeros(count, np.int64), np.zeros(count), np.zeros(count, np.int64)
        seed = _mix(seeds + np.uint64(1000 + number))
        pick = uniform(_mix(seed + np.uint64(3)), np.zeros(count))
        walkers = []
        for t in open_texts.tolist():
            path = paths[source[t]]
            lo = int(path.at[t])
            at = lo + int(path.leave[lo:lo + path.sizes[t]].argmax())
            place = int(lattice.start_of(path.edges[at]))
            used = taken.setdefault((t, int(source[t]), at), [int(path.edges[at])])
            all_edges = np.arange(lattice.first[place], lattice.first[place + 1])
            chance = np.exp(lattice.log[all_edges])
            for edge in used:
                chance[edge - all_edges[0]] = 0.0
            running = np.cumsum(chance)
            choice = int(all_edges[min(np.searchsorted(running, pick[t] * running[-1], side="right"), len(running) - 1)])
            used.append(choice)
            with np.errstate(divide="ignore"):
                chance[choice - all_edges[0]] = 0.0
                rest = np.log(chance.sum())
                # the branch stays open for what it still holds, now below the value just given out
                path.leave[at] = -np.inf if not chance.any() else float(_below(
                    np.array([path.before[at] + rest]), score[t:t + 1],
                    uniform(_mix(seed[t:t + 1] + np.uint64(5)), np.zeros(1)))[0])
                log[t] = path.before[at] + lattice.log[choice]
            path.refresh(t)
            step = int(path.begin[t]) + at - lo
            begin[t] = step + 1
            fresh_first[t] = choice
            # the unit the branch lies in: units before it are complete after their steps
            if number == 1 and source[t] == 0:
                done = steps[unit_first[t]:unit_first[t] + per_text[t]]
            else:
                done = unit_steps[source[t]][t]
            unit = int(np.searchsorted(np.cumsum(done), step, side="right"))
            walkers.append((t, unit))
        texts_of = np.array([t for t, _ in walkers])
        first_unit = unit_first[texts_of] + np.array([u for _, u in walkers])
        rest_units = unit_first[texts_of] + per_text[texts_of] - first_unit
        heads = np.cumsum(rest_units) - rest_units
        unit_of = np.arange(int(rest_units.sum())) - np.repeat(heads, rest_units) + np.repeat(first_unit, rest_units)
        owner = np.repeat(texts_of, rest_units)
        place = lattice.unit_start[codes[unit_of]].copy()
        place[heads] = lattice.end[fresh_first[texts_of]]
        new_edges, new_steps = walk(lattice, place, lattice.unit_end[codes[unit_of]],
                                    text_place[unit_of] + place - lattice.unit_start[codes[unit_of]], seed[owner])
        new_sizes = np.bincount(owner, new_steps, count).astype(np.int64)
        paths.append(_Paths(lattice, new_edges, new_sizes, begin, log, score, seed))
        whole.append([None] * count)
        if number == 1:
            unit_steps = [[steps[a:a + n] for a, n in zip(unit_first, per_text)]]
        unit_steps.append([None] * count)
        for k, (t, unit) in enumerate(walkers):
            parent = whole[source[t]][t]
            a = int(paths[-1].at[t])
            whole[-1][t] = np.concatenate([parent[:begin[t] - 1], fresh_first[t:t + 1], new_edges[a:a + new_sizes[t]]])
            old = unit_steps[source[t]][t]
            fresh = new_steps[heads[k]:heads[k] + rest_units[k]].copy()
            fresh[0] += begin[t] - int(old[:unit].sum())
            unit_steps[-1][t] = np.concatenate([old[:unit], fresh])
            results[t].append((whole[-1][t], float(paths[-1].log[t]), float(score[t])))
    flat_ids, widths = ids_of(lattice, np.concatenate([e for found in results for e, _, _ in found]),
                              [len(e) for found in results for e, _, _ in found])
    pieces = iter(np.split(flat_ids, np.cumsum(widths)[:-1]))
    out = []
    for t, found in enumerate(results):
        with np.errstate(over="ignore", divide="ignore"):
            out.append([(next(pieces), log, value,
                         float(np.log(-np.expm1(-np.exp(log - last[t])))) if last[t] > -np.inf else 0.0) for _, log, value in found])
    return out


def ids_of(lattice: Lattice, edges: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of paths laid end to end, and ids per path; a character without a piece becomes its bytes."""
    ids, lengths_of = lattice.piece[edges], np.asarray(sizes, np.int64)
    missing = np.flatnonzero(ids < 0)
    if len(missing):
        chars = lattice.chars[lattice.start_of(edges[missing])]
        distinct, which = np.unique(chars, return_inverse=True)
        spelled = [chr(_BLANK if c == _OWN_BLANK else c).encode("utf-8", "surrogatepass") for c in distinct.tolist()]
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        width = lengths[which]
        owner = np.searchsorted(np.cumsum(lengths_of), missing, side="right")
        lengths_of = lengths_of + np.bincount(owner, width - 1, len(sizes)).astype(np.int64)
        widths = np.ones(len(ids), np.int64)
        widths[missing] = width
        ids = np.repeat(ids, widths)
        as_bytes = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int32) + lattice.vocabulary.first_byte
        begins = (np.cumsum(lengths) - lengths)[which]
        step = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        ids[ids < 0] = as_bytes[np.repeat(begins, width) + step]
    return ids, lengths_of


_SAMPLE = "ids array<int>, log_prob double, perturbed double, inclusion double"


def encode_samples(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", samples: int = SAMPLES,
                   seed: int = SEED, carry: tuple[str, ...] = (), group_chars: int = GROUP_CHARS,
                   unit_chars: int = UNIT_CHARS) -> DataFrame:
    """``(key, *carry, sample, ids, log_prob, perturbed, inclusion)``: distinct segmentations of each whole text, best first.

    The draws depend on the row's key and the seed only. A null or empty text has one segmentation, the empty one.
    A text with fewer segmentations than asked for gives all it has, each certain to be included (score 0).
    Repeated rows are sampled alike; a null key is a key of its own. An empty table gives an empty result.
    Larger ``group_chars`` and ``unit_chars`` take memory and save processor time; they change no draw.
    """
    names = [key, *carry]
    schema = docs.select(*names).withColumn("sample", F.lit(0)).schema.simpleString()[len("struct<"):-1] + ", " + _SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary, unit_chars)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names) + 1).to_pylist()]
            keys = np.asarray(batch.column(len(names))).astype(np.int64).view(np.uint64)
            at = 0
            while at < len(texts):
                held, stop = 0, at
                while stop < len(texts) and (held == 0 or held + len(texts[stop]) <= group_chars):
                    held += len(texts[stop])
                    stop += 1
                found = sample_group(texts[at:stop], keys[at:stop], lattice, samples)
                row = np.repeat(np.arange(at, stop), [len(f) for f in found])
                each = [s for f in found for s in f]
                offsets = np.concatenate([[0], np.cumsum([len(s[0]) for s in each])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([s[0] for s in each]).astype(np.int32)))
                carried = [batch.column(i).take(pa.array(row)) for i in range(len(names))]
                number = np.concatenate([np.arange(1, len(f) + 1) for f in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*carried, pa.array(number), ids, *(pa.array([s[i] for s in each], pa.float64()) for i in (1, 2, 3))],
                    names=[*names, "sample", "ids", "log_prob", "perturbed", "inclusion"])
                at = stop

    rows = docs.select(*names, F.xxhash64(F.lit(seed), F.col(key)).alias("_seed"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, schema)


def decode_ids(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text that ids spell, in Spark's own functions: bytes are joined, the blank in front is taken off.

    No ids give an empty text, a null a null. The table of pieces is one literal, bounded by the vocabulary.
    """
    table = F.split(F.lit(",".join(t.hex() for t in vocabulary.texts)), ",")
    spelled = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")).cast("string")
    return F.substring(spelled, 2, 2147483647)
