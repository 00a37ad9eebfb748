"""Versions of the streamed cache: replaced copies go, the cache and a repeated batch stay right."""

import random
import time

from pagemill.schemas import RESOURCES
from pagemill.streaming.cache_stream import compact, latest_version, merge_batch, read_cache, replaced_copies

BATCHES = 14


def batch_of(spark, rows):
    return spark.createDataFrame(rows, RESOURCES)


def held(frame):
    return {(r.url, r.html, r.fetched_at) for r in frame.collect()}


def copies(root):
    return sorted(str(p.relative_to(root)) for p in root.glob("version=*/bucket=*"))


def test_replaced_copies_go(spark, tmp_path):
    rng, want, urls = random.Random(3), {}, [f"https://s.org/{i}" for i in range(5)]
    root, merge, last = tmp_path / "cache", merge_batch(str(tmp_path / "cache"), grace=0.0), []
    for number in range(BATCHES):
        last = [(u, 200, f"{u} {number}", float(number)) for u in rng.sample(urls, 2)] + [("https://s.org/bad", 500, "x", 99.0)]
        merge(batch_of(spark, last), number)
        want.update({u: (u, body, at) for u, status, body, at in last if status == 200})
        assert len(copies(root)) <= 2 * len(urls)
    assert held(read_cache(spark, str(root))) == set(want.values())
    assert len(list(root.glob("version=*"))) < BATCHES and latest_version(spark, str(root)) == BATCHES - 1
    # the last batch may come again after a restart
    merge(batch_of(spark, last), BATCHES - 1)
    assert held(read_cache(spark, str(root))) == set(want.values())


def test_copies_stay_for_their_readers(spark, tmp_path):
    root, merge = str(tmp_path / "cache"), merge_batch(str(tmp_path / "cache"))
    for number in range(3):
        merge(batch_of(spark, [("https://s.org/a", 200, f"v{number}", float(number))]), number)
        if number == 0:
            early = read_cache(spark, root)
    assert held(early) == {("https://s.org/a", "v0", 0.0)}      # a reader from before, within its grace
    assert replaced_copies(spark, root) == []
    later = time.time() + 25 * 3600
    # version 2 may still be repeated from version 1, so only version 0 is done with
    assert [p.rpartition("version=")[2][0] for p in replaced_copies(spark, root, now=later)] == ["0"]
    # a version without its mark replaces nothing and is not touched
    (tmp_path / "cache" / "version=7" / "bucket=1").mkdir(parents=True)
    assert compact(spark, root, now=later) == 1 and (tmp_path / "cache" / "version=7").exists()
    assert held(read_cache(spark, root)) == {("https://s.org/a", "v2", 2.0)}
    assert compact(spark, root, now=later) == 0 and compact(spark, str(tmp_path / "none")) == 0
