"""URL classes, credential links and order sketches against plain Python, and rows that repeat."""

import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import order_minhash, secret_links, url_aliases

SCOPE = secret_links.SCOPE


def plain_links(text):
    """Weak spans whose complement lies in scope, by finditer and all pairs."""
    found = {}
    for kind, pattern in {**dict(secret_links.BASE), **secret_links.WEAK}.items():
        found[kind] = [m for m in re.finditer(pattern, text, re.A)]
    least = {"assign": lambda m: len(m[2]) >= secret_links.ASSIGN_VALUE, "access": lambda m: len(m[0]) >= secret_links.ACCESS_LENGTH,
             "hex": lambda m: len(m[0]) >= secret_links.HEX_LENGTH}
    base = [(m.start(), m.end(), k) for k in least for m in found[k] if least[k](m)]
    weak = [(m.start(), m.end(), k) for k in secret_links.WEAK for m in found[k]]
    weak = [w for w in weak if not any(b[0] <= w[0] and w[1] <= b[1] for b in base)]
    told = []
    for s, e, kind in weak:
        role = secret_links.ROLES[kind]
        near = {secret_links.ROLES[k] for s2, e2, k in base + weak if s2 <= e + SCOPE and s <= e2 + SCOPE} - {role}
        if {"identifier": "secret" in near, "secret": "identifier" in near, "endpoint": {"secret", "identifier"} <= near}[role]:
            told.append((s, e, kind))
    return sorted(base), sorted(told)


PARTS = ["user_name = anna.b", "client_id: 'x-99'", "https://db.example.org/a?b", "postgres://h:1/x", "AKIA" + "A1" * 9, "token = abc",
         "password: hunter2longer", "Zz9" * 12, "zz" * 20, "deadbeef" * 3, "login=me_2", "account: \"", "mongodb://", "AbC0" * 8 + "=="]


def random_text(rng):
    return "".join(rng.choice(PARTS) + rng.choice([" ", "\n", ", ", "; "]) + "word " * rng.choice([0, 1, 3, 30, 38, 39, 40, 60])
                   for _ in range(rng.randint(0, 9)))


def test_linked_parts_match_plain_python(spark):
    rng = random.Random(11)
    texts = [random_text(rng) for _ in range(400)] + ["", None]
    rows = list(enumerate(texts)) + [(7, texts[7]), (7, texts[8]), (None, texts[9])]    # repeated and null ids
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("clash")).withColumn("start", F.lit(1))
    names = secret_links.KINDS
    got = sorted((str(r.doc_id), sorted((s.start, s.end, names[s.kind]) for s in r.base), sorted((s.start, s.end, names[s.kind]) for s in r.linked))
                 for r in secret_links.scan_secrets(df).collect())
    want = sorted((str(i), *plain_links(t or "")) for i, t in rows)
    assert got == want
    assert sum(bool(w[2]) for w in want) > 100
    assert secret_links.scan_secrets(df.limit(0)).count() == 0


def chained(*values):
    """Hashes of strings, (long, width) numbers or None one after the other, each seeded by the one before."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q" if v[1] == 8 else "<i", v[0])
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_sketches(text):
    bits, pos = order_minhash.SKETCH_BITS, 24
    words = [chained(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    k = order_minhash.K
    if not words:
        return []
    kmers = [chained(*((w, 8) for w in words))] if len(words) < k else [
        chained(*((w, 8) for w in words[i:i + k])) for i in range(len(words) - k + 1)]
    seen, sketches = {}, {}
    for at, h in enumerate(kmers):
        kmer = h >> pos
        number = seen.get(kmer, 0)
        seen[kmer] = number + 1
        mixed = chained((kmer, 8), (number, 4))
        sketches.setdefault(mixed >> (64 - bits), []).append((mixed >> pos, at))
    out = []
    for name, items in sorted(sketches.items()):
        least = sorted(sorted(items)[:order_minhash.PER_SKETCH], key=lambda x: x[1])
        low = (1 << (64 - bits - pos)) - 1
        tupled = chained(*((h & low, 8) for h, _ in least)) & ((1 << 64) - 1)
        value = (name << (64 - bits)) | (tupled >> bits)
        out.append(value)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = [" ".join(rng.choice(["alpha", "b", "été", "你好", "x1", "\U0001f600"]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 9, 40, 200, 3000)]
    return made + ["", " \t\n", "one", "same " * 500, " lead\tand\x0btrail \r\n", " not a break here"]


def test_sketches_match_plain_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.s for r in df.select("i", order_minhash.sketches(F.col("text")).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_sketches(text), text[:60]


def test_fingerprints_of_rows_match_plain_python(spark, texts):
    """Successors by ascending id, edited texts and both fingerprints."""
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(200, None), (-5, "the very first row of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_tie", F.lit(1)).withColumn("sketch", F.lit("clash"))
    got = {r.doc_id: r for r in order_minhash.fingerprint_documents(df).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(ordered)
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        assert (got[i].n_chars, got[i].edited) == (len(text), edited)
        assert got[i].sketch == plain_sketches(text) and got[i].edited_sketch == plain_sketches(edited)
        assert got[i].next_sketch == plain_sketches(following)


def plain_verdicts(urls, edges):
    """Verdict per URL by union-find over URLs and their forms."""
    def parts(url):
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        return host.lower(), re.match("[^?#]*", rest[len(host):])[0]

    def form(url):
        host, path = parts(url)
        path = re.sub(r"/+\Z", "", re.sub(r"/index\.html?\Z", "", path))
        query = re.match(r"[^?#]*(?:\?([^#]*))?", url)[1] or ""
        kept = [q for q in query.split("&") if q and not re.match(r"(utm_[a-z]+|ref|gclid|fbclid)=", q)]
        return "form", host + path + ("?" + "&".join(kept) if kept else "")

    def action(url):
        host, path = parts(url)
        fits = [(len(h + p), a) for a, h, p in url_aliases.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    up = {}
    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    good = [u for u in urls if u and "://" in u] + [u for e in edges for u in e]
    for u in good:
        up[find(u)] = find(form(u))
    for a, b in edges:
        up[find(a)] = find(b)
    said = {}
    for u in good:
        said.setdefault(find(u), set()).add(action(u))
    def verdict(u):
        if not u or "://" not in u:
            return "allow", False
        told = said[find(u)]
        return (action(u) or ("allow" if "allow" in told or "block" not in told else "block"),
                action(u) is None and told != {None})
    return [verdict(u) for u in urls]


@pytest.mark.parametrize("seed", range(3))
def test_classes_match_union_find(spark, seed):
    """Chains of forms, redirects and allowed members; a hub of many URLs; repeated, null and odd URLs."""
    rng = random.Random(seed)
    hosts = [f"h{i}.org" for i in range(25)] + ["a.net", "b.net", "sub.example.com", "x.org", "WWW.h3.org"]
    def url():
        return (rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(["/p", "/q/r", "/es/a", "/fr/b", "/en/c"])
                + rng.choice(["", "/", "//", "/index.html", "/index.htm"]) + rng.choice(["", "?ref=1", "?a=1&utm_source=x", "?a=1", "#f"]))
    urls = [url() for _ in range(250)] + [None, "", "nothing", "://"] + [f"http://hub.org/p?utm_source=s{i}" for i in range(200)]
    urls += urls[:20]
    edges = [(url(), url()) for _ in range(12)] + [("http://hub.org/p#1", "http://c1.org/"), ("https://c1.org", "http://bad.net/es/1")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("root", F.lit("clash"))
    links = spark.createDataFrame(edges, "url string, target string")
    got = {r.page_id: (r.verdict, r.propagated) for r in url_aliases.judge_urls(pages, links).collect()}
    want = dict(enumerate(plain_verdicts(urls, edges)))
    assert {i: (urls[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert len(got) == len(urls) and sum(p for _, p in got.values()) >= 200
