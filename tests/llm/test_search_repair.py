"""Ranked search against plain scoring, conversation repair against trying every list of edits."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import ball_tree, turn_repair

CLASH = ("score", "rank", "n", "terms", "_row", "_key", "_fault", "_piece", "term", "times", "audit", "_copy", "_dropped")


# ---- ranked search ----

def plain_terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in
            re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranking(docs, items, top=20):
    counts = [(d, collections.Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in plain_terms(text) if t in c)
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **kw):
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})
    right = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})
    return sorted((tuple(r) for r in ball_tree.rank_documents(left, right, **kw).collect()), key=repr)


def sentence(rng, n):
    return " ".join(rng.choice(["Sun", "moon", "été", "x9", "Wort", "中文", "tide", "a-b", "don't", "zeta"]) + rng.choice(["", "", "1", "ß"])
                    for _ in range(n))


def test_ranking_matches_plain_scores(spark):
    rng = random.Random(4)
    docs = [(i, sentence(rng, rng.randint(0, 60))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, " .,;"), (None, "sun moon"), (153, docs[3][1]), (154, docs[3][1]), (7, docs[7][1]),
             (155, "tide " * 5000), (156, "TIDE\x00Sun\x7fmoon")]
    items = [(i, sentence(rng, rng.randint(1, 12))) for i in range(12)] + [(20, None), (21, "unknown words only"), (22, "?!"), (None, "sun")]
    assert ranked(spark, docs, items) == plain_ranking(docs, items)
    assert ranked(spark, docs, items, top=3, item_block=4) == plain_ranking(docs, items, 3)


def test_ranking_of_nothing(spark):
    assert ranked(spark, [], [(1, "sun")]) == [] and ranked(spark, [(1, "sun")], []) == []
    assert ranked(spark, [(1, None)], [(1, "sun")]) == []


def random_rows(rng, n, width, groups=None):
    columns, values, at = [], [], [0]
    for i in range(n):
        base = rng.integers(0, 8) * 12 if groups else 0
        used = np.sort(rng.choice(12 if groups else width, rng.integers(1, 9), replace=False)) + base
        columns.append(used)
        values.append(rng.integers(1, 700_000, len(used)))
        at.append(at[-1] + len(used))
    return ball_tree.Rows(np.concatenate(columns), np.concatenate(values), np.array(at))


@pytest.mark.parametrize("groups", [False, True])
def test_no_bound_lies_below_a_row(groups):
    rng = np.random.default_rng(8)
    rows = random_rows(rng, 700, 96, groups)
    tree = ball_tree.Tree(rows, 96, 16)
    queries = rng.integers(0, 14_000, (20, 96)) * (rng.random((20, 96)) < 0.1)
    bounds = tree.bounds(queries.astype(float))

    def members(node):
        return tree.leaves[node][0].tolist() if node in tree.leaves else sum((members(c) for c in tree.children[node]), [])

    assert sorted(members(0)) == list(range(700))
    opened = 0
    for number, query in enumerate(queries):
        scores = rows.dot(query)
        for node in range(len(tree.radii)):
            assert scores[members(node)].max() <= bounds[number, node]
        best = []
        opened += ball_tree.search(tree, query, bounds[number], np.arange(700), best, 5)
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:5]
        assert sorted(best, reverse=True) == want
    if groups:  # rows in clusters: most subtrees are never opened
        assert opened < 0.7 * 20 * len(tree.leaves)


# ---- conversation repair ----

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def plain_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def plain_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def every_repair(rows, faults):
    """Cheapest edits by trying all, with up to two inserts at each place."""
    inserts = [list(c) for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    best = None

    def go(at, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for more in inserts:
            spent, letters, so_far = cost + 3 * len(more), audit + "I" * len(more), out + [(r, "") for r in more]
            if at == len(rows):
                if GRAMMAR.match("".join(r[:1] or " " for r, _ in so_far)) and (best is None or (spent, letters) < best[:2]):
                    best = (spent, letters, so_far)
                continue
            _, role, text = rows[at]
            go(at + 1, spent + 4, letters + "D", so_far)
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 if faults[at] == "truncated" else 0
                go(at + 1, spent + extra, letters + "K", so_far + [(role, text)])
                for new in ("user", "assistant"):
                    go(at + 1, spent + 3 + extra, letters + "R", so_far + [(new, text)])

    go(0, 0, "", [])
    return best


def plain_repair(rows):
    """Cheapest, then least edits by whole strings per state, for conversations too long to try all."""
    faults, follows = plain_faults(rows), {"": "u", "s": "u", "u": "a", "a": "u"}
    names, states = {"u": "user", "a": "assistant"}, {"": (0, "", ())}

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for s, (cost, audit, out) in list(states.items()):
                t = follows[s]
                new = (cost + 3, audit + "I", out + (names[t] + ":",))
                if t not in states or new[:2] < states[t][:2]:
                    states[t] = new
        return states

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        # a state may be reached dearer but be worth more inserts later, so inserts are tried from every state
        for s, (cost, audit, out) in inserted(states).items():
            ways = [(s, 4, "D", out)]
            if fault not in ("blank", "duplicate"):
                extra, r = 3 * (fault == "truncated"), role[:1]
                if (s, r) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    ways.append((r, extra, "K", (*out, f"{role}:{text}")))
                ways.append((follows[s], 3 + extra, "R", (*out, f"{names[follows[s]]}:{text}")))
            for t, more, letter, new in ways:
                entry = (cost + more, audit + letter, new)
                if t not in after or entry[:2] < after[t][:2]:
                    after[t] = entry
        states = after
    return min((v for s, v in inserted(states).items() if s in ("", "a")), key=lambda v: v[:2])


def expected(rows):
    out = []
    for conv, turns in plain_damage(rows).items():
        faults = plain_faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, kept = plain_repair(turns)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_turns(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["", "  \t", "Yes.", "No!", "perhaps", "Why? ", "é 中.\n", "and so on", "a.b", None]
    return [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice(texts)) for c in range(conversations) for t in range(rng.randint(1, longest)) if rng.random() < 0.9]


def repaired(spark, rows, **kw):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in CLASH})
    return sorted((tuple(r) for r in turn_repair.repair(turn_repair.damage(frame), copy="_copy", dropped="_dropped", **kw).collect()), key=repr)


def test_plain_programme_matches_trying_all():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(t, rng.choice(["user", "assistant", "system", "tool", "assistant"]), rng.choice(["Yes.", "No.", "", "and", "Why?"]))
                for t in range(rng.randint(0, 3))]
        cost, audit, out = every_repair(rows, plain_faults(rows))
        assert (cost, audit, tuple(f"{r}:{t}" for r, t in out)) == plain_repair(rows), rows


def test_repair_matches_plain_version(spark):
    rows = random_turns(5, 400, 12) + [(None, None, None, None), (None, 1, "user", "Hi."), (-3, 2, "user", "One."), (-3, 2, "assistant", "Two."),
                                       (-3, 2, "user", "One."), (-4, 0, "user", "long " * 60_000)]
    want = expected(rows)
    assert repaired(spark, rows) == want
    # pieces of two rows: pointers leave the task and are traced across pieces
    assert repaired(spark, rows, spill_rows=2) == want


def test_long_conversation_over_many_batches(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "so", f"Turn {t}."])) for t in range(3000)]
    got = repaired(spark, rows, spill_rows=700)
    assert got == expected(rows) and len(got[0][7]) > 2000


def test_dropped_and_empty(spark):
    gone = [(c, t, "user", "Hi.") for c in range(200) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    assert [r[1:] for r in repaired(spark, gone)] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * len(gone)
    assert repaired(spark, []) == []


def test_state_does_not_grow_with_the_conversation():
    import sys

    talk = turn_repair._Conversation("c")
    for t in range(5000):
        talk.add(t, "user" if t % 3 else "assistant", "x", turn_repair._SOUND)
    assert len(talk.pointers) == 20_000 and sys.getsizeof(talk.costs) + sys.getsizeof(talk.ranks) < 500
    assert max(c for c in talk.costs if c is not None) < 20  # kept relative to the cheapest
