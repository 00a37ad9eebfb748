"""Sequential parts of chunking: cutting oversized text and packing blocks into chunks.

Packing carries text from one chunk into the next, so it runs in order inside a page; pages run in
parallel. Costs are kept as counts while text is joined, so every character is weighed once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

# The ranges of text.CJK in Python syntax, sentence ends, slicing and overlap units.
_CJK_SET = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af"
_CJK = re.compile(f"[{_CJK_SET}]")
_SENTENCE_END = re.compile(r"(?<=[。！？])(?=\S)|(?<=[.!?])\s+")
_SLICE_UNIT = re.compile(rf"[{_CJK_SET}]|[^\s{_CJK_SET}]+|\s+")
_TAIL_UNIT = re.compile(rf"[{_CJK_SET}]|[A-Za-z0-9_]+|.")
_PARAGRAPH_GAP = re.compile(r"\n\s*\n")

MAX_TOKENS = 1500
OVERLAP = 120

_CHUNKS = pa.list_(pa.struct([
    ("heading_path", pa.list_(pa.string())), ("tokens", pa.int32()), ("text", pa.string())]))


def _cjk(text: str) -> int:
    return 0 if text.isascii() else len(_CJK.findall(text))


def _tokens(cjk: int, length: int) -> int:
    return cjk + (length - cjk + 3) // 4


def _cost(text: str) -> int:
    return _tokens(_cjk(text), len(text))


def _tail(text: str, units: int) -> str:
    return "".join(_TAIL_UNIT.findall(text)[-units:]) if units else ""


def _filled(units, limit: int, weigh):
    """Concatenate units greedily; yields ``(text, cost)``, a lone unit may exceed ``limit``."""
    held: list[str] = []
    state = weigh("")
    for unit in units:
        grown = state + weigh(unit)
        if held and grown.cost > limit:
            yield "".join(held), state.cost
            held, grown = [], weigh(unit)
        held.append(unit)
        state = grown
    if held:
        yield "".join(held), state.cost


class _Text:
    """Weight of running text: the rounding happens once, over the sum."""

    __slots__ = ("cjk", "length")

    def __init__(self, text: str = "", cjk: int = 0, length: int = 0) -> None:
        self.cjk, self.length = (_cjk(text), len(text)) if text else (cjk, length)

    def __add__(self, other: "_Text") -> "_Text":
        return _Text(cjk=self.cjk + other.cjk, length=self.length + other.length)

    @property
    def cost(self) -> int:
        return _tokens(self.cjk, self.length)


class _Unit:
    """Weight of slicing units: every unit is rounded up on its own."""

    __slots__ = ("cost",)

    def __init__(self, text: str = "", cost: int | None = None) -> None:
        single = len(text) == 1 and _CJK.match(text)
        self.cost = cost if cost is not None else 1 if single else (len(text) + 3) // 4

    def __add__(self, other: "_Unit") -> "_Unit":
        return _Unit(cost=self.cost + other.cost)


def _cut_paragraph(paragraph: str, limit: int) -> list[str]:
    """Sentences packed up to ``limit``; only a last run that is still too long is sliced by words."""
    runs = list(_filled((s for s in _SENTENCE_END.split(paragraph) if s.strip()), limit, _Text))
    pieces = [text.strip() for text, _ in runs[:-1]]
    for text, cost in runs[-1:]:
        pieces += [t for t, _ in _filled(_SLICE_UNIT.findall(text), limit, _Unit)] if cost > limit else [text.strip()]
    return pieces


def cut_oversized(text: str, limit: int) -> list[str]:
    """Pieces of a text over ``limit``: whole paragraphs where they fit, else sentences, else word slices."""
    if _cost(text) <= limit:
        return [text]
    pieces: list[str] = []
    held, weight, gap = "", _Text(), _Text("\n\n")
    for paragraph in filter(None, map(str.strip, _PARAGRAPH_GAP.split(text))):
        own = _Text(paragraph)
        if own.cost > limit:
            pieces += [held] if held else []
            pieces += _cut_paragraph(paragraph, limit)
            held, weight = "", _Text()
        elif (weight + gap + own).cost > limit:
            pieces.append(held)     # empty when a first paragraph fits only without its blank line
            held, weight = paragraph, own
        else:
            held, weight = (f"{held}\n\n{paragraph}", weight + gap + own) if held else (paragraph, own)
    return pieces + [held] if held else pieces


def pack_blocks(blocks: list[dict], max_tokens: int, overlap: int, tail: str = "", follows: bool = False) -> list[dict]:
    """Chunks of ``{heading_path, text}`` blocks; a chunk is labelled with the path of its last block.

    ``tail`` is the end of the text before the blocks; ``follows`` says that a chunk of plain blocks was closed there, so the
    first chunk starts with it.
    """
    chunks: list[dict] = []
    held, held_cjk, path = "", 0, []

    def add(where: list[str], cost: int, text: str) -> None:
        chunks.append({"heading_path": where, "tokens": cost, "text": text})

    for block in blocks:
        text = block["text"]
        cjk = _cjk(text)
        oversized = _tokens(cjk, len(text)) > max_tokens
        full = oversized or _tokens(held_cjk + cjk, len(held) + 2 + len(text)) > max_tokens
        if held and full:
            add(path, _tokens(held_cjk, len(held)), held.strip())
            tail = _tail(held, overlap)
        if oversized:
            for piece in cut_oversized(text, max_tokens - overlap):
                joined = f"{tail}\n\n{piece}" if tail else piece
                add(block["heading_path"], _cost(joined), joined)
                tail = _tail(piece, overlap)
            held, held_cjk = "", 0
        elif follows or held and full:
            held = f"{tail}\n\n{text}" if tail else text
            held_cjk = _cjk(held)
        else:
            held, held_cjk = f"{held}\n\n{text}".strip(), held_cjk + cjk
        path, follows = block["heading_path"], False
    if held:
        add(path, _tokens(held_cjk, len(held)), held.strip())
    return chunks


@lru_cache(maxsize=None)
def _packer(max_tokens: int, overlap: int):
    @F.arrow_udf(from_arrow_type(_CHUNKS))
    def pack(blocks: pa.Array) -> pa.Array:
        return pa.array([pack_blocks(b or [], max_tokens, overlap) for b in blocks.to_pylist()], _CHUNKS)
    return pack


@lru_cache(maxsize=None)
def _part_packer(max_tokens: int, overlap: int):
    @F.arrow_udf(from_arrow_type(_CHUNKS))
    def pack(blocks: pa.Array, tails: pa.Array, follows: pa.Array) -> pa.Array:
        return pa.array([pack_blocks(b or [], max_tokens, overlap, t or "", bool(f)) for b, t, f in
                         zip(blocks.to_pylist(), tails.to_pylist(), follows.to_pylist())], _CHUNKS)
    return pack


def starts_of_parts(lengths: list[int], size: int) -> list[int]:
    """First blocks of the parts of a text: a part is closed once it holds ``size`` characters."""
    starts, held = [], size
    for no, length in enumerate(lengths):
        if held >= size:
            starts.append(no)
            held = 0
        held += length
    return starts


@lru_cache(maxsize=None)
def _part_finder(size: int):
    @F.arrow_udf(from_arrow_type(pa.list_(pa.int32())))
    def find(lengths: pa.Array) -> pa.Array:
        return pa.array([starts_of_parts(v or [], size) for v in lengths.to_pylist()], pa.list_(pa.int32()))
    return find


@lru_cache(maxsize=None)
def _cutter(max_tokens: int):
    @F.arrow_udf(from_arrow_type(pa.list_(pa.string())))
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([cut_oversized(t or "", max_tokens) for t in texts.to_pylist()], pa.list_(pa.string()))
    return cut


def chunks_of(blocks: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    return _packer(max_tokens, overlap)(blocks)


def part_starts(lengths: Column, size: int) -> Column:
    return _part_finder(size)(lengths)


def part_chunks(blocks: Column, tail: Column, follows: Column, max_tokens: int, overlap: int) -> Column:
    return _part_packer(max_tokens, overlap)(blocks, tail, follows)


def split_oversized(text: Column, max_tokens: int) -> Column:
    return _cutter(max_tokens)(text)
