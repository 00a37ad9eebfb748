"""Repeated passages against a dictionary of all strings of 50 bytes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import suffix_dedup

CLASH = ("_id", "_hash", "_body", "_records", "spans", "kept", "part", "told", "n_bytes")


def plain(docs, width=50):
    """``(id, bytes, spans, kept)`` of (id, text) rows."""
    first = {}
    for d, t in docs:
        if d is not None:
            body = (t or "").encode()
            for i in range(len(body) - width + 1):
                s = body[i:i + width]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in docs:
        body = (t or "").encode()
        gone = bytearray(len(body))
        if d is not None:
            for i in range(len(body) - width + 1):
                if first[body[i:i + width]] < d:
                    gone[i:i + width] = b"\1" * width
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(body) if at < 0 else at
            spans.append((a, at))
        out.append((d, len(body), spans, bytes(b for b, g in zip(body, gone) if not g)))
    return sorted(out, key=repr)


def found(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})
    rows = suffix_dedup.drop_repeats(frame).collect()
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows), key=repr)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_matches_every_string(spark):
    rng = random.Random(1)
    passages = [words(rng, 40) for _ in range(4)] + ["é中\U0001F600" * 12, "x" * 49, "y" * 50, "0123456789" * 5]
    docs = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 12)
            parts.insert(rng.randint(0, len(parts)), p[cut:] if rng.random() < 0.5 else p)
        docs.append((100 - i if i % 2 else i, rng.choice([" ", ""]).join(parts)))
    docs += [(200, None), (201, ""), (202, docs[3][1]), (203, docs[3][1]), (203, docs[3][1]), (203, docs[5][1]), (None, docs[3][1]),
             (None, None), (-5, docs[7][1][20:]), (204, "z" * 3000), (205, "z" * 49), (206, "a" + "z" * 50), (207, "é" * 60), (208, "é" * 25),
             (209, "\x00" * 60), (210, "\x00" * 51)]
    assert found(spark, docs) == plain(docs)


def test_shifts_of_every_residue(spark):
    """A string of exactly 50 bytes at every pair of places modulo 3 and beside either end of a text."""
    rng = random.Random(3)
    docs, number = [], 0
    for a in range(4):
        for b in range(4):
            for end in (0, 1, 2, 5):
                s = words(rng, 30)[:50]
                docs += [(number, words(rng, 9)[:a] + s + words(rng, 9)[:end]), (number + 1, words(rng, 9)[:b] + s + words(rng, 9)[:3 - end])]
                number += 2
    got = found(spark, docs)
    assert got == plain(docs)
    assert all(sum(e - s for s, e in spans) >= 50 for d, _, spans, _ in got if d % 2)


def test_long_text_over_several_parts(spark):
    """A text of more than a batch: windows on the borders of its parts are compared too."""
    rng = np.random.default_rng(5)
    body = rng.integers(97, 123, suffix_dedup.BATCH + 90_000, np.uint8).tobytes().decode()
    border = suffix_dedup.BATCH
    docs = [(1, body[border - 60:border + 40]), (2, body), (3, "start " + body[border - 26:border + 30] + " end"), (4, body[:200] + body[-150:])]
    got = {d: (spans, kept) for d, _, spans, kept in found(spark, docs)}
    assert got[1][0] == [] and got[2][0] == [(border - 60, border + 40)]
    assert got[3] == ([(6, 62)], b"start  end") and got[4] == ([(0, 350)], b"")
    assert hashlib.sha256(got[2][1]).hexdigest() == hashlib.sha256((body[:border - 60] + body[border + 40:]).encode()).hexdigest()


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "short"), (2, "short")], [(None, "q" * 80), (None, "q" * 80)]])
def test_nothing_to_drop(spark, docs):
    assert found(spark, docs) == plain(docs)


def test_parts_hold_every_window_and_suffix(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 64)
    text = bytes(range(256)) * 3
    for group in suffix_dedup.parts_of([(0, text)]):
        for _, offset, part in group:
            assert text[offset:offset + len(part)] == part
    parts = [p for g in suffix_dedup.parts_of([(0, text)]) for p in g]
    for at in range(len(text) - 49):
        assert any(o <= at and at + 50 <= o + len(p) for _, o, p in parts)
        lead, trail = min(at, 2), min(at + 50, len(text))
        assert any(o <= at - lead and trail <= o + len(p) for _, o, p in parts)
