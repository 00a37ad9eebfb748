"""The stages keep the documents' columns and take effect; queries run over whole tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import lattice_sampling, queries, site_lines, subword_classifier, weighted_mix

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_another(spark):
    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test_stage")
        assert docs.columns == COLUMNS and docs.dtypes == before.dtypes, name
        counts.append(docs.count())
    assert counts[0] <= 200 and counts[1] == counts[0] and 0 < counts[2] <= counts[1] and counts[3] > 0
    encoded = corpus_pipeline.encode(spark, docs, SF)
    assert encoded.filter("sample = 1").count() == docs.count()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    rows = [(1, None, None, None, None), (None, "some text", "en", "a", 9), (2, "", "en", "a", 0), (3, "x y z " * 50, "en", "a", 300),
            (3, "x y z " * 50, "en", "a", 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, SF).collect()
    assert len({r.doc_id for r in out}) >= 1
    assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", queries.queries())
def test_queries_return_a_row_per_row(spark, name):
    tables = {"op1": "pages", "op9": "embeddings"}
    out = queries.queries()[name](spark, SF)
    kind = name.split("_")[0]
    if kind in ("op4", "op12", "op13"):
        assert out.count() > 0
    elif kind == "op6":
        assert out.filter("not round_trip").count() == 0
    else:
        assert out.count() == spark.read.parquet(f"{SF}/{tables.get(kind, 'documents')}.parquet").count()


def plain_sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", words) if w]
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_near_dedup(rows):
    """One row of each group of near copies: least (no id, id, text hash), by comparing all with all."""
    sets, group = [plain_sets(r["text"]) for r in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            group[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["hash"])) for g in groups.values()]


def plain_line_dedup(rows):
    pages, lines = collections.Counter(r["source"] for r in rows), collections.Counter()
    visible = lambda line: line.strip(" \t\r\x0b\x0c")
    for r in rows:
        lines.update({(r["source"], line) for line in (r["text"] or "").split("\n") if visible(line)})
    out = []
    for r in rows:
        old = (r["text"] or "").split("\n")
        new = [x for x in old if not visible(x) or lines[r["source"], x] < 2
               or lines[r["source"], x] <= site_lines.RATIO * pages[r["source"]]]
        text = None if r["text"] is None else "\n".join(new)
        out.append({**r, "text": text, "n_chars": len(text) if len(new) < len(old) else r["n_chars"]})
    return out


def odd_documents():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 90))) for _ in range(60)]
    rows = [(i, t + ("\nshared footer" if i % 3 else ""), "en", f"s{i % 4}", 5) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] + " and one more", "en", "s1", 5) for i in range(8)]
    rows += [(7, texts[20], "en", "s2", 5), (7, texts[7] + "\nshared footer", "en", "s3", 5), (7, texts[7] + "\nshared footer", "en", "s3", 5)]
    rows += [(None, " ".join(word() for _ in range(12)), "en", None, 5) for _ in range(20)] + [(None, texts[3], "en", "s0", 5)]
    return rows + [(300, None, "en", "s0", None), (301, "", "en", "s0", 0), (302, " \n ", None, None, 3), (303, "one", "en", "s1", 3),
                   (304, "one", "en", "s1", 3)]


def hashed(spark, frame):
    return [r.asDict() for r in frame.withColumn("hash", F.xxhash64("text")).collect()]


def keyed(rows):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_matches_comparing_all(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    want = plain_near_dedup(hashed(spark, docs))
    assert keyed(r.asDict() for r in got.collect()) == keyed(want)
    assert len(want) <= docs.count() - 10


def test_unlike_texts_of_one_id_both_stay(spark):
    rows = [(1, "one two three four five six seven", "en", "a", 1), (1, "seven other words stand in this text", "en", "a", 1),
            (2, "a third text of its own has these words", "en", "a", 1)]
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).count() == 3


def test_mix_counts_rows_one_by_one(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    taken = weighted_mix.mix_sources(docs).collect()
    want = sum(int(r.taken / r.size + 0.5) if r["size"] else 0 for r in taken)
    assert corpus_pipeline.mix(spark, docs, SF).count() == want


def test_run_matches_plain_python(spark, tmp_path):
    """All stages over a written fixture: the kept texts by plain versions, then the ids decoded to them."""
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 5 != 0), 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    rows = hashed(spark, docs)
    label = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    by_id = {}
    for r in rows:
        if r["doc_id"] in label:
            by_id[r["doc_id"]] = min(by_id.get(r["doc_id"], r["text"]), r["text"])
    ids = sorted(by_id)
    model = subword_classifier.fit([by_id[i].encode() for i in ids], np.array([label[i] for i in ids]))
    logits = subword_classifier.logits_of([(r["text"] or "").encode() for r in rows], model)
    rows = plain_line_dedup([r for r, x in zip(rows, logits) if x >= 0])
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], SCHEMA)
    rows = plain_near_dedup(hashed(spark, frame))
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], SCHEMA)
    copies = collections.Counter()
    for r in weighted_mix.mix_sources(frame.withColumn("t", F.monotonically_increasing_id()), row="t").join(
            frame.withColumn("_row", F.monotonically_increasing_id()).select("_row", "text"), "_row").collect():
        copies[r.doc_id, r.text] += int(r.taken / r.size + 0.5) if r["size"] else 0

    vocabulary = lattice_sampling.load_vocabulary(f"{lattice_sampling.TOKENIZERS}/{lattice_sampling.MODEL}")
    out = corpus_pipeline.run(spark, str(tmp_path)).withColumn("text", lattice_sampling.decode_ids(F.col("ids"), vocabulary))
    got = collections.Counter((r.doc_id, r.text) for r in out.filter("sample = 1").collect())
    assert got == +copies and len(got) > 30
