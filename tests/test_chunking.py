import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as t
from pagemill.functions.packing import _cost, _tail, cut_oversized, pack_blocks, starts_of_parts
from pagemill.operators.chunking import chunk_documents, chunk_parts, corpus_rows, split_blocks

from test_urls import one

CJK_DOC = "# 甲章\n\n开头的文字。\n\n## 甲一节\n\n中间的话。\n\n# 乙章\n\n末尾的话。\n"


def chunked(spark, docs, max_tokens=1500, overlap=120):
    frame = spark.createDataFrame(list(enumerate(docs)), "id int, markdown string")
    rows = sorted(chunk_documents(frame, max_tokens, overlap).collect(), key=lambda r: (r.id, r.seq))
    return [[r for r in rows if r.id == i] for i in range(len(docs))]


def blocks(spark, docs):
    frame = spark.createDataFrame(list(enumerate(docs)), "i int, v string")
    rows = sorted(frame.select("i", split_blocks(F.col("v")).alias("b")).collect())
    return [[(b.heading_path, b.text) for b in r.b] for r in rows]


def stack_blocks(markdown):
    """The block rule stated line by line, with a list of open headings."""
    out, open_headings, buffer = [], [], []
    for line in [*markdown.splitlines(), None]:
        level = len(line) - len(line.lstrip("#")) if line else 0
        heading = 0 < level <= 6 and line[level:level + 1].isspace()
        if (heading or line is None) and buffer:
            out.append(([title for _, title in open_headings], "\n".join(buffer).strip()))
            buffer = []
        if heading:
            open_headings = [h for h in open_headings if h[0] < level] + [(level, line[level:].strip())]
        if line is not None:
            buffer.append(line)
    return out


def test_tokens(spark):
    cases = ["你好世界", "hello world", "", "a你b", "éé한글", "ｱ", "\U0001f600abc"]
    want = [4, 3, 0, 2, 3, 1, 1]
    assert one(spark, cases, t.approx_tokens(F.col("v"))) == want == [_cost(c) for c in cases]


def test_tail(spark):
    cases = ["abc def", "你好 ab_1, x", "a\nb c", "", "\r x"]
    assert one(spark, cases, t.overlap_tail(F.col("v"), 3)) == ["abc def", ", x", "b c", "", "\r x"]
    assert one(spark, cases, t.overlap_tail(F.col("v"), 0)) == [""] * 5


def test_lines(spark):
    cases = ["", "\n", "a", "a\n", "a\r\nb\x0bc\x85d \n", "\n\na"]
    assert one(spark, cases, t.lines(F.col("v"))) == [c.splitlines() for c in cases]


EDGES = ["", "\n", "# A", "\n# A", "# A\n## B\n### C\n# D", "### C\n# A\n## B\n#### E\n## F", "#x\n# \n#\n####### y\n # z",
         "```\n# in code\n```", "# A\r\n\x0b## B text\x85# C\n", "text\n\n# A\n\n\n", "##　T \n#\x0cnot"]


def test_blocks_on_edges(spark):
    assert blocks(spark, EDGES) == [stack_blocks(e) for e in EDGES]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="#a \n\r ", max_size=60), min_size=30, max_size=60))
def test_blocks_match_a_heading_stack(spark, docs):
    assert blocks(spark, docs) == [stack_blocks(d) for d in docs]


def test_basic_fixture(spark):
    chunks, = chunked(spark, [CJK_DOC], 20, 10)
    assert len(chunks) >= 2 and all(c.tokens <= 30 for c in chunks)
    assert [c.heading_path for c in chunks if "中间" in c.text][0] == ["甲章", "甲一节"]


def test_oversized_fixture(spark):
    chunks, = chunked(spark, ["# 长文\n\n" + "这里有一句话。" * 230], 100, 10)
    assert len(chunks) > 1 and all(c.tokens <= 110 for c in chunks)


def test_overlap_fixture(spark):
    chunks, = chunked(spark, ["# X\n\n" + "前半部分。" * 60 + "\n\n# Y\n\n" + "后半部分。" * 60], 100, 20)
    texts = [c.text for c in chunks]
    assert len(texts) >= 2 and any(a[-20:] in b for a, b in zip(texts, texts[1:]))


def test_path_fixture(spark):
    chunks, = chunked(spark, ["# 一\n\n## 二\n\n### 三\n\n正文。"], 1000)
    assert [c.heading_path for c in chunks] == [["一", "二", "三"]]


def test_packing_by_hand():
    """Four characters cost one token: limits and tails can be counted by eye."""
    def pack(*texts, limit=4, overlap=1):
        return [(c["text"], c["tokens"], c["heading_path"]) for c in
                pack_blocks([{"heading_path": [str(i)], "text": x} for i, x in enumerate(texts)], limit, overlap)]
    # two blocks fit with their blank line: 4 + 2 + 4 characters are 3 tokens; the label is the last block's
    assert pack("aaaa", "bbbb") == [("aaaa\n\nbbbb", 3, ["1"])]
    # the next chunk starts with the tail and may exceed the limit
    assert pack("aaaa bb", "c" * 16) == [("aaaa bb", 2, ["0"]), ("bb\n\n" + "c" * 16, 5, ["1"])]
    # an oversized block is cut at limit - overlap; the block after it gets no tail
    assert pack("aa", "b" * 8 + ". " + "c" * 8, "dd") == [
        ("aa", 1, ["0"]), ("aa\n\n" + "b" * 8 + ".", 4, ["1"]), (".\n\n" + "c" * 8, 3, ["1"]), ("dd", 1, ["2"])]
    # empty blocks change nothing
    assert pack("", "aa", "", "bb") == [("aa\n\nbb", 2, ["3"])] and pack("", "") == []
    # a blank at the start of a tail is counted but not kept
    assert pack("aaaaaaaaaaaa bb", "cccc", overlap=2) == [("aaaaaaaaaaaa bb", 4, ["0"]), ("bb\n\ncccc", 3, ["1"])]


def test_cutting_by_hand():
    assert cut_oversized("abcd", 1) == ["abcd"]
    assert cut_oversized("aaaa\n\nbbbb\n \ncccc", 3) == ["aaaa\n\nbbbb", "cccc"]
    # sentences are joined without the blank that parted them
    assert cut_oversized("aa. bb. cc. dd.", 2) == ["aa.bb.", "cc.dd."]
    # an earlier sentence over the limit passes whole, the last one is sliced between words
    assert cut_oversized("a" * 12 + ". " + "bbbb cccc dddd", 2) == ["a" * 12 + ".", "bbbb ", "cccc ", "dddd"]
    # a first paragraph that fits only without its blank line leaves an empty piece before it
    assert cut_oversized("a" * 12 + "\n\n" + "bb", 3) == ["", "a" * 12, "bb"]
    assert cut_oversized("你好。再见。早安", 3) == ["你好。", "再见。", "早安"]


words = st.lists(st.sampled_from(["alpha", "b", "你好", "x.", "一。", "end!", "\n\n", "\n", "# H\n", "averyveryverylongword"]), max_size=120)


@settings(max_examples=60, deadline=None)
@given(words, st.integers(5, 40))
def test_no_text_is_lost_without_overlap(tokens, limit):
    text = " ".join(tokens)
    got = pack_blocks([{"heading_path": [], "text": b.strip()} for b in re.split(r"(?=# H\n)", text)], limit, 0)
    squeeze = lambda s: re.sub(r"\s+", "", s)
    assert squeeze("".join(c["text"] for c in got)) == squeeze(text)
    # a chunk exceeds the limit only when it is one sentence, or one word, that does
    for chunk in got:
        assert chunk["tokens"] <= limit or "\n\n" not in chunk["text"]


def test_same_chunks_for_any_partitioning(spark):
    docs = [(i, CJK_DOC * (i % 5) + "word " * (i * 37)) for i in range(40)]
    frame = spark.createDataFrame(docs, "id int, markdown string")
    one_, many = (sorted(chunk_documents(frame.repartition(n), 60, 8).collect()) for n in (1, 7))
    assert one_ == many
    for i in range(40):
        seqs = [r.seq for r in one_ if r.id == i]
        assert sorted(seqs) == list(range(len(seqs)))


def packed_in_parts(markdown, max_tokens, overlap, size):
    """Plain version of ``chunk_parts``."""
    found = [{"heading_path": p, "text": x} for p, x in stack_blocks(markdown)]
    starts = starts_of_parts([len(b["text"]) for b in found], size)
    out = []
    for no, (start, end) in enumerate(zip(starts, starts[1:] + [len(found)])):
        before = found[starts[no - 1]:start] if no else []
        out += pack_blocks(found[start:end], max_tokens, overlap, _tail("\n\n".join(b["text"] for b in before), overlap),
                           bool(before) and _cost(before[-1]["text"]) <= max_tokens)
    return [(c["heading_path"], c["tokens"], c["text"]) for c in out]


def test_parts(spark):
    """Long texts in parts: many of them, the overlap carried on, numbers without gaps, other columns kept."""
    section = "{h} Part {n}\n\n" + "Some words in a row. " * 4 + "{x}\n\n"
    texts = ["".join(section.format(h="#" * (1 + n % 4), n=n, x="long tail " * (60 if n % 5 == 2 else n % 3)) for n in range(k))
             for k in (40, 1, 7)] + ["", None, CJK_DOC * 9, "no heading " * 300, "# only\n" * 50]
    frame = spark.createDataFrame(list(enumerate(texts)), "part int, markdown string").withColumnRenamed("part", "id")
    rows = sorted(chunk_parts(frame, 60, 8, 500).collect(), key=lambda r: (r.id, r.seq))
    for i, text in enumerate(texts):
        got = [r for r in rows if r.id == i]
        assert [r.seq for r in got] == list(range(len(got)))
        assert [(r.heading_path, r.tokens, r.text) for r in got] == (packed_in_parts(text, 60, 8, 500) if text else [])
    assert len(starts_of_parts([len(x) for _, x in stack_blocks(texts[0])], 500)) > 5


def test_one_part_equals_the_whole(spark):
    docs = [(i, CJK_DOC * (i + 1) + "word " * (i * 37)) for i in range(12)]
    frame = spark.createDataFrame(docs + docs[:2], "id int, markdown string")
    assert sorted(chunk_parts(frame, 60, 8).collect()) == sorted(chunk_documents(frame, 60, 8).collect())


def test_corpus_rows_of_both_kinds(spark):
    pages = [("s", f"u{i}", "p", "t", CJK_DOC * n, e) for i, (n, e) in enumerate([(1, ""), (40, ""), (40, "HTTP 404"), (0, "")])]
    frame = spark.createDataFrame(pages, "site string, url string, path string, title string, markdown string, error string")
    rows = sorted(corpus_rows(frame, 60, 8, 300).collect(), key=lambda r: (r.url, r.seq))
    assert [(r.url, r.seq) for r in rows if r.url == "u1"] == [("u1", i) for i in range(len(packed_in_parts(CJK_DOC * 40, 60, 8, 300)))]
    assert {r.url for r in rows} == {"u0", "u1"} and [r.seq for r in rows if r.url == "u0"] == [0]
