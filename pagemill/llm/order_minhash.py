"""Order MinHash fingerprints, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import WORD_BREAK

# k-mers are runs of this many words; a shorter text is one k-mer.
K = 3
# Number of sketches as a power of two, and k-mers per sketch.
SKETCH_BITS, PER_SKETCH = 5, 2
# The ids are cut into at most this many ranges for finding each document's successor.
RANGES = 1024

# Low bits of a packed number hold a position; positions beyond them wrap, alike for equal texts.
_POS = 24
_MASK = (1 << _POS) - 1


def _packed(hashed: Column, position: Column) -> Column:
    """High bits of the hash, low bits the position: sorts by hash, then by place in the text."""
    return hashed.bitwiseAND(F.lit(~_MASK)).bitwiseOR(position.cast("bigint").bitwiseAND(F.lit(_MASK)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def kmer_hashes(text: Column, k: int = K) -> Column:
    """``array<bigint>`` of k-mer hashes in text order; one for a text of fewer words, none for one without."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.transform(F.split(trimmed, WORD_BREAK + "+", -1), lambda w: F.xxhash64(w))

    def runs(w: Column) -> Column:
        whole = F.array(F.xxhash64(w))
        each = F.transform(F.slice(w, k, F.size(w)), lambda last, i: F.xxhash64(*(F.get(w, i + j) for j in range(k - 1)), last))
        return F.when(F.size(w) < k, whole).otherwise(each)

    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(_let(words, runs))


def numbered(kmers: Column) -> Column:
    """Packed (hash of the k-mer and its occurrence number, position), sorted."""
    by_kmer = F.sort_array(F.transform(kmers, lambda h, i: _packed(h, i)))

    def with_runs(items: Column) -> Column:
        same = lambda x, i: F.shiftright(x, _POS) == F.shiftright(F.get(items, i - 1), _POS)
        firsts = F.filter(F.transform(items, lambda x, i: F.when((i > 0) & same(x, i), -1).otherwise(i)), lambda i: i >= 0)

        def number(starts: Column) -> Column:
            # a run of equal k-mers counts up from 0, so runs laid end to end number every occurrence
            ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(items)))
            occurrence = F.flatten(F.zip_with(starts, ends, lambda s, e: F.sequence(F.lit(0), e - s - 1)))
            return F.zip_with(items, occurrence, lambda x, o: _packed(F.xxhash64(F.shiftright(x, _POS), o), x))

        return F.sort_array(_let(firsts, number))

    return _let(by_kmer, with_runs)


def sketches(text: Column, k: int = K, bits: int = SKETCH_BITS, per: int = PER_SKETCH) -> Column:
    """``array<bigint>`` fingerprint: one number per sketch that has k-mers, its top bits naming the sketch.

    One hash orders the numbered k-mers and deals them to sketches by its top bits; of each sketch the least
    ``per`` stay, go back to text order, and are hashed as a tuple. So a sketch changes with the set of its
    minimal k-mers, with their repetition and with their order.
    """
    top = lambda x: F.shiftright(x, 64 - bits)

    def pick(items: Column) -> Column:
        least = F.filter(items, lambda x, i: (i < per) | (top(x) != top(F.coalesce(F.get(items, i - per), x + 1))))
        # sketch, then place, then hash, in one number
        placed = F.transform(least, lambda x: F.shiftleft(top(x), 64 - bits).bitwiseOR(
            F.shiftleft(x.bitwiseAND(F.lit(_MASK)), 64 - bits - _POS)).bitwiseOR(
            F.shiftrightunsigned(F.shiftleft(x, bits), _POS + bits)))
        return _let(F.sort_array(placed), tuples)

    def tuples(items: Column) -> Column:
        kmer = lambda x: x.bitwiseAND(F.lit((1 << (64 - bits - _POS)) - 1))
        opens = lambda x, i: (i == 0) | (top(x) != top(F.coalesce(F.get(items, i - 1), x)))

        def hashed(x: Column, i: Column) -> Column:
            more = [F.when(top(F.get(items, i + j)) == top(x), kmer(F.get(items, i + j))) for j in range(1, per)]
            tuple_hash = F.xxhash64(kmer(x), *more)
            return F.when(opens(x, i), F.shiftleft(top(x), 64 - bits).bitwiseOR(F.shiftrightunsigned(tuple_hash, bits)))

        return F.filter(F.transform(items, hashed), lambda x: x.isNotNull())

    return F.coalesce(_let(numbered(kmer_hashes(text, k)), pick), F.array().cast("array<bigint>"))


def likeness(one: Column, two: Column, bits: int = SKETCH_BITS) -> Column:
    """Share of equal sketches among those either text has; 1 for two texts without k-mers."""
    names = lambda a: F.transform(a, lambda x: F.shiftright(x, 64 - bits))
    either = F.size(F.array_union(names(one), names(two)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, two)) / either)


def fingerprint_string(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _halve(cuts: Column, step: int):
    return lambda at: F.when(F.col("doc_id") >= F.get(cuts, at + step - 1), at + step).otherwise(at)


def with_next(docs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``(doc_id, text, _range, _tie, _extra)``: rows in ranges of ids, each range ending with the first row of the next.

    Texts are shuffled once, by range; a window over a range then sees every successor. The last range ends with the
    very first row. Bounds are quantiles, so ranges are even; what the driver learns is one id per range.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    count = max(1, min(ranges, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.25 / count)))
    cuts = F.array(*(F.lit(int(b)) for b in bounds)).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    # the position is found by halving: bounds are sorted
    place = F.lit(0)
    step = 1 << max(0, len(bounds).bit_length() - 1) if bounds else 0
    while step:
        place = _let(place, _halve(cuts, step))
        step >>= 1
    ranged = docs.withColumn("_range", F.coalesce(place, F.lit(0)).cast("int"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("_tie").alias("tie"))
    firsts = {r._range: r.first for r in ranged.groupBy("_range").agg(F.min(order).alias("first")).collect()}
    if not firsts:
        return ranged.withColumn("_extra", F.lit(False))
    used = sorted(firsts)
    rows = [(used[i - 1], f.known, f.id, f.tie) for i, f in enumerate(firsts[r] for r in used)]  # the first goes after the last
    goes = spark.createDataFrame([(int(r), bool(k), int(i), int(t)) for r, k, i, t in rows],
                                 "_to int, _known boolean, _id bigint, _t bigint")
    extra = (ranged.join(F.broadcast(goes), (F.col("doc_id").isNotNull() == F.col("_known"))
                         & (F.coalesce("doc_id", F.lit(0)) == F.col("_id")) & (F.col("_tie") == F.col("_t")))
             .dropDuplicates(["_to"]).select("doc_id", "text", "_tie", F.col("_to").alias("_range"), F.lit(True).alias("_extra")))
    return ranged.withColumn("_extra", F.lit(False)).unionByName(extra)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_chars, edited, sketch, edited_sketch, next_sketch)`` per row, ids ascending deciding the successor.

    The edited text has its last quarter (rounded down) of code points replaced by the first as many, or all, of the
    next document; the last document is followed by the first. A null text is an empty one, which has no
    sketches. Null ids come first; rows of one id follow by a hash of their text. A lone row is followed by itself. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("_range").orderBy("_extra", F.col("doc_id").asc_nulls_first(), "_tie")
    chained = with_next(rows).withColumn("_next", F.lead("text").over(order))
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"),
                      F.expr("substring(coalesce(_next, ''), 1, cast(floor(length(text) / 4) as int))"))
    edited = F.when(cut > 0, edited).otherwise(F.col("text"))
    own = chained.select("doc_id", "_range", "_tie", "_extra", n.cast("bigint").alias("n_chars"), "text",
                         edited.alias("edited"))
    own = own.select("doc_id", "_range", "_tie", "_extra", "n_chars", "edited", sketches(F.col("text")).alias("sketch"),
                     F.when(~F.col("_extra"), sketches(F.col("edited"))).alias("edited_sketch"))
    return (own.withColumn("next_sketch", F.lead("sketch").over(order)).filter(~F.col("_extra"))
            .select(F.col("doc_id").alias(key), "n_chars", "edited", "sketch", "edited_sketch", "next_sketch"))
