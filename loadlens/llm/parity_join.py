"""N-gram Jaccard join by parity sketches.

A set's parity sketch is a bit string in which each shingle flips one bit. Each element of the
symmetric difference of two sets flips one bit of the XOR of their sketches, so the Hamming distance of
two sketches is at most the size of that difference. Two sets of s and t elements with a Jaccard
similarity of at least p/100 differ in at most d = (s+t)(100-p)/(100+p) elements. Cut into d+1 pieces,
their sketches therefore agree exactly in one piece at least. Pieces are joined per size band, and
each candidate pair is verified on the whole texts.

Pairs inside a bucket are never all emitted. Each bucket first compares its members with one pivot.
Members of the same component need no further comparison. Small rests of buckets are paired, under the
triangle inequality of the Jaccard distance and the sketches' bound; members of crowded ones, which are
mostly far copies of one text, meet again on their rarest shingles alone: of two sets of at least p/100
similarity, each has a common shingle among its first s - ceil(s*p/100) + 1 in any order, and rarest
first what they all have in common comes last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loadlens.llm.common import discard, materialize, rows_with, small_batches
from loadlens.llm.graph import components

_MASK48 = np.uint64((1 << 48) - 1)
#: Bits of the dense sketches that are kept with a set, for the lower bound on the difference of a candidate pair: of the
#: coarse one, and most of the fine one, which has two or more for each element up to there.
_COARSE, _FINEST = 1024, 16_384
#: Cuts of a set with many empty pieces, each of which has few enough with even odds at worst; the last one keeps them all.
_CUTS = 32
#: A bucket is hot if the sample puts more than this share of all keys into it: there can be no more than its inverse. The
#: rows of a hot bucket are dealt out over so many parts.
_HOT_SHARE, _SAMPLE, _PARTS = 1 / 65_536, 64, 255
#: A bucket with more pairs than this for each member, between classes of different components, is crowded.
_CROWDED = 4


class _Words(dict):
    """64-bit hashes of words; emptied when large, so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, n: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h))


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _spaces(size: int, percent: int) -> list[tuple[int, int]]:
    """(space, d) for the spaces of keys in which a set of this size takes part, d being the most in which two sets of the
    space that link can differ. A band spans the sizes from U*(percent/100)**2 to U; pairs of one band meet in the band's
    own space, and pairs of two bands, which are neighbours, in a space of their common boundary."""
    ratio, most = percent / 100, (100 - percent) / (100 + percent)
    if math.floor(size * (1 + 1 / ratio) * most + 1e-6) < 1:
        return []  # only equal sets link, and those are one class already
    step = -2 * math.log(ratio)
    band = math.floor(math.log(size) / step + 1e-9)
    # the ends of what floor() puts into the band, with slack for rounding
    lower, upper = math.exp(band * step) * (1 + 1e-6), math.exp((band + 1) * step) * (1 + 1e-6)
    wide = 1 + 1 / ratio
    out = [(2 * band, math.floor(2 * upper * most + 1e-6))]
    if size / ratio >= upper * (1 - 1e-5):
        out.append((2 * band + 1, math.floor(wide * upper * most + 1e-6)))
    if size * ratio <= lower:
        out.append((2 * band - 1, math.floor(wide * lower * most + 1e-6)))
    return [(space, d) for space, d in out if d]


def _choices(d: int) -> tuple[int, int]:
    """(pieces, m): for a difference of at most d, the pieces to cut and how many of them make a key together. Of d+m+r
    pieces at least m+r agree, so that a set with no more than r empty ones may leave those out."""
    m = 3 if d <= 4 else 2 if d <= 10 else 1
    reserve = 3 if d <= 3 else 2 if d <= 7 else 3 if d <= 10 else 2 - (-d * 12 // 100)
    return d + m + reserve, m


@lru_cache(maxsize=256)
def _together(n: int, m: int) -> np.ndarray:
    return np.array(list(combinations(range(n), m)), np.int64).reshape(-1, m)


def sketch_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """48-bit keys of the pieces of a set's sketches. hashes must be sorted: pieces are then runs of it.

    Pieces that agree are empty in both sets or in neither, and a key of empty pieces selects nothing, so they make no
    keys. A set with more empty pieces than there are in reserve meets others of its kind in further cuts by other
    hashes; of two sets that link, the first to have few enough decides, and both have the keys of that cut."""
    keys = []
    for space, d in _spaces(len(hashes), percent):
        pieces, m = _choices(d)
        for cut in range(_CUTS + 1):
            own = hashes if not cut else np.sort(_mix(hashes + np.uint64(cut * 0x9FB21C651E98DF25 & (1 << 64) - 1)))
            piece = ((own >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)  # ascends with the hash
            bit = _mix((own & np.uint64(0xFFFFF)) + (piece << np.uint64(20)) + np.uint64(1))  # of 2**20 bits a piece
            value = np.zeros(pieces, np.uint64)
            starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            value[piece[starts].astype(np.int64)] = np.bitwise_xor.reduceat(bit, starts)
            salt = np.uint64(((space + 2) * (_CUTS + 1) + cut) * 0xA24BAED4963EE407 & (1 << 64) - 1)
            key = _mix(value + (np.arange(pieces, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + salt)
            full = value != 0
            filled = int(full.sum())
            if cut < _CUTS:
                key = key[full]
            if m > 1:
                together = _together(len(key), m).T
                joint = key[together[0]]
                for column in together[1:]:
                    joint = _mix(joint + key[column])
                key = joint
            keys.append(key)
            if filled >= d + m:
                break
    return np.concatenate(keys) & _MASK48 if keys else np.empty(0, np.uint64)


def dense_sketch(hashes: np.ndarray, bits: int = _COARSE) -> np.ndarray:
    """The parity of the elements on each of a number of bits (a power of two), as 64-bit integers."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_sketch(hashes: np.ndarray) -> np.ndarray:
    return dense_sketch(hashes, max(_COARSE, min(_FINEST, 1 << (2 * len(hashes)).bit_length())))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            size, hi, lo, coarse, fine = [], [], [], [], []
            with np.errstate(over="ignore"):
                for text in batch.column(1):
                    h = shingle_hashes(text.as_py(), n, cache)
                    a, b = _fingerprint(h)
                    size.append(len(h)), hi.append(a), lo.append(b), coarse.append(dense_sketch(h)), fine.append(fine_sketch(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(coarse, pa.list_(pa.int64())), pa.array(fine, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp_hi", "fp_lo", "coarse", "fine"])

    return run


def _keys(n: int, percent: int, hot: frozenset, every: int = 1):
    """(key, doc_id) rows; a text met before in the same task gives none, which is the map-side combine for copies. A hot key
    has the number of one of its parts, from 1, above its 48 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, met = _Words(), set()
        hot_keys = np.fromiter(sorted(hot), np.uint64, len(hot))

        def batch_of(ids, keys, sizes):
            k = np.concatenate(keys)
            i = np.repeat(np.asarray(ids, np.int64), sizes)
            if len(hot_keys):
                loud = hot_keys[np.minimum(np.searchsorted(hot_keys, k), len(hot_keys) - 1)] == k
                k[loud] += (_mix(i[loud].astype(np.uint64)) % np.uint64(_PARTS) + np.uint64(1)) << np.uint64(48)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(i)], names=["key", "doc_id"])

        for batch in batches:
            ids, keys, sizes, total = [], [], [], 0
            with np.errstate(over="ignore"):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if doc is None or every > 1 and xxhash.xxh3_64_intdigest(str(doc)) % every:
                        continue
                    h = shingle_hashes(text.as_py(), n, cache)
                    if not len(h):
                        continue
                    if every == 1:
                        fp = _fingerprint(h)
                        if fp in met:
                            continue
                        if len(met) > 100_000:
                            met.clear()
                        met.add(fp)
                    k = sketch_keys(h, percent)
                    ids.append(doc), keys.append(k), sizes.append(len(k))
                    total += len(k)
                    if total > 500_000:
                        yield batch_of(ids, keys, sizes)
                        ids, keys, sizes, total = [], [], [], 0
            if ids:
                yield batch_of(ids, keys, sizes)

    return run


def _overlap(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, left = _Words(), None, None
        for batch in batches:
            common, linked = [], []
            with np.errstate(over="ignore"):
                for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                    if last is None or ta != last:
                        last, left = ta, shingle_hashes(ta.as_py(), n, cache)
                    right = shingle_hashes(tb.as_py(), n, cache)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    common.append(both), linked.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "common", "linked"])

    return run


def _texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (doc_id, text) of these ids (doc_id, distinct)."""
    return rows_with(texts.where("doc_id is not null"), ids, "doc_id")


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, common, linked): the shared shingles of each pair, counted on the whole texts, and whether it links. Only texts of
    the pairs are shuffled. Where an id has several texts, any two of them link it."""
    texts = _texts(texts, materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids"))
    right = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "b", F.col("text").alias("text_b"))
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_overlap(n, percent), "a long, b long, common long, linked boolean").groupBy("a", "b").agg(F.max("common").alias("common"), F.bool_or("linked").alias("linked"))


def _least_difference(p: Column, q: Column) -> Column:
    """Hamming distance of two dense sketches: no more than the size of the symmetric difference of the sets. A sketch of
    twice as many bits is folded first; of more, nothing is said, as sets of such sizes do not link."""
    half = lambda x, i: F.slice(x, (i * F.size(x) / 2 + 1).cast("int"), (F.size(x) / 2).cast("int"))
    fold = lambda x, y: F.when(F.size(x) == 2 * F.size(y), F.zip_with(half(x, 0), half(x, 1), lambda u, v: u.bitwiseXOR(v))).otherwise(x)
    distance = F.aggregate(F.zip_with(fold(p, q), fold(q, p), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(distance, F.lit(0))


def _sure(condition: Column) -> Column:
    """A bound that rules out; what is not known rules out nothing."""
    return F.coalesce(condition, F.lit(True))


def _bounded(pairs: DataFrame, kind: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that may link by the sizes of both sets and a lower bound on the number of elements in which they differ."""
    for side in "ab":
        pairs = pairs.join(kind.select(F.col("cls").alias(side), F.col("size").alias(f"size_{side}"), F.col("fine").alias(f"fine_{side}")), side)
    apart = F.abs(F.col("size_a") - F.col("size_b"))
    pairs = pairs.select("a", "b", "size_a", "size_b", F.when(apart.isNotNull(), F.greatest(_least_difference(F.col("fine_a"), F.col("fine_b")), apart)).alias("differ"))
    return pairs.withColumn("may_link", _sure(F.expr(f"100 * (size_a + size_b - differ) >= {percent} * (size_a + size_b + differ)")))


def _cross(rows: DataFrame, on: str, top: DataFrame, more: Column, percent: int) -> DataFrame:
    """Pairs (a, b) of classes (x) of different components that share on; top has the component of most rows of each value.

    Of such a pair one at least is not of that component, so rows of one component alone never meet. more is a condition
    on the two sides, p and q."""
    p, q = rows.join(top, on).where("component <> top").alias("p"), rows.alias("q")
    size_p, size_q, gap = F.col("p.size"), F.col("q.size"), _least_difference(F.col("p.sketch"), F.col("q.sketch"))
    once = (F.col("q.component") == F.col("p.top")) | (F.col("p.x") < F.col("q.x"))
    fit = _sure(100 * F.least(size_p, size_q) >= percent * F.greatest(size_p, size_q)) & _sure(100 * (size_p + size_q - gap) >= percent * (size_p + size_q + gap))
    met = p.join(q, (F.col(f"p.{on}") == F.col(f"q.{on}")) & (F.col("p.component") != F.col("q.component")) & once & more & fit)
    return met.select(F.least("p.x", "q.x").alias("a"), F.greatest("p.x", "q.x").alias("b"))


def _top(rows: DataFrame, on: str) -> DataFrame:
    """For each value of on with several components: the one with most rows, the rows, and the pairs across components."""
    n = rows.groupBy(on, "component").agg(F.count("*").alias("n")).groupBy(on)
    n = n.agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("rows"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("across"))
    return n.where("across > 0")


def _shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            with np.errstate(over="ignore"):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    h = shingle_hashes(text.as_py(), n, cache)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), doc, np.int64))], names=["e", "x"])

    return run


def _rare_first(crowd: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(e, x) for the shingles of the classes of crowd (x, size) that are among the first of their set, rarest first.

    A shingle of one class alone takes its place and is left out; so is a class whose first ones are all of that kind. A
    class of unknown size keeps all."""
    shingles = _texts(texts, crowd.select(F.col("x").alias("doc_id"))).select("doc_id", "text").mapInArrow(_shingles(n), "e long, x long")
    often = shingles.groupBy("e").agg(F.count("*").alias("f")).where("f > 1")
    shared = shingles.join(often, "e").distinct().join(crowd.select("x", "size"), "x")
    place = F.row_number().over(Window.partitionBy("x").orderBy("f", "e")) + F.col("size") - F.count("*").over(Window.partitionBy("x"))
    first = F.col("size") - F.floor((F.col("size") * percent + 99) / 100) + 1
    return shared.withColumn("place", place).where(_sure(F.col("place") <= first)).select("e", "x")


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Words are maximal runs without ASCII white space, after lower-casing A-Z. Two documents link when
    100*|A∩B| >= percent*|A∪B| over their sets of distinct shingle-word sequences; component_id is the
    smallest doc_id reachable by links. Null, empty and blank texts have no shingles and link with
    nothing; a text with fewer words than a shingle has one shingle, its whole sequence. Rows that share
    a doc_id are one vertex, linked by any of their texts; a null doc_id links with nothing and has a null
    component_id. Other columns are ignored. An empty table gives an empty table.
    """
    with small_batches(docs.sparkSession):  # all that goes through Python is written before it returns
        return _components(docs, shingle, percent, doc_id, text)


def _components(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str) -> DataFrame:
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = materialize(base.mapInArrow(_sets(shingle), "doc_id long, n_shingles long, fp_hi long, fp_lo long, coarse array<long>, fine array<long>"), "sets")
    alive = sets.where("n_shingles > 0 and doc_id is not null")
    # exact copies of a set: one class each, named by its smallest doc_id
    classes = materialize(alive.groupBy("fp_hi", "fp_lo").agg(F.min("doc_id").alias("cls")), "classes")
    own = lambda c: F.when(F.col("doc_id") == F.col("cls"), F.col(c)).alias(c)
    member = materialize(alive.join(classes, ["fp_hi", "fp_lo"]).select("doc_id", "cls", "fp_hi", F.col("n_shingles").alias("size"), own("coarse"), own("fine")).dropDuplicates(["doc_id", "cls", "fp_hi"]), "member")
    # where a doc_id names several sets nothing is known of their sizes
    one = F.min("fp_hi") == F.max("fp_hi")
    kind = member.where("doc_id = cls").groupBy("cls").agg(*(F.when(one, F.any_value(c)).alias(c) for c in ("size", "coarse", "fine")))

    multi = materialize(_buckets(base, shingle, percent), "buckets")
    placed = multi.join(member.select("doc_id", F.col("cls").alias("x")), "doc_id").select("key", "x", "rep")
    placed = materialize(placed.join(member.select(F.col("doc_id").alias("rep"), F.col("cls").alias("pivot")), "rep").select("key", "x", "pivot").distinct(), "placed")
    discard(multi)

    star = materialize(_bounded(placed.where("x <> pivot").select(F.col("pivot").alias("a"), F.col("x").alias("b")).distinct(), kind, percent), "star")
    checked = materialize(_verify(star.where("may_link").select("a", "b"), base, shingle, percent), "checked")
    links = checked.where("linked").select("a", "b")
    first = materialize(components(links), "components")

    # what the pivots did not settle: buckets whose classes lie in several components
    named = placed.join(first.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    top = materialize(_top(named, "key"), "open")
    about = kind.select(F.col("cls").alias("x"), "size", F.col("coarse").alias("sketch"))
    # bounds on each member's Jaccard distance from its pivot: exact where the texts were compared
    differ = F.coalesce(F.col("size_a") + F.col("size_b") - 2 * F.col("common"), "differ")
    least = 2 * differ / (F.col("size_a") + F.col("size_b") + differ)
    distance = star.join(checked, ["a", "b"], "left").select(F.col("a").alias("pivot"), F.col("b").alias("x"), F.coalesce(least, F.lit(0.0)).alias("least_far"), F.when(F.col("common").isNotNull() & least.isNotNull(), least).otherwise(1.0).alias("most_far"))
    few = named.join(top.where(F.col("across") <= _CROWDED * F.col("rows")).select("key"), "key").join(distance, ["pivot", "x"], "left").join(about, "x")
    far = lambda c: F.when(F.col("x") == F.col("pivot"), 0.0).otherwise(F.col(c)).alias(c)
    few = materialize(few.select("key", "x", "size", "sketch", "component", far("least_far"), far("most_far")), "few")
    apart = 1 - percent / 100 + 1e-9
    near_enough = _sure(F.col("p.least_far") - F.col("q.most_far") <= apart) & _sure(F.col("q.least_far") - F.col("p.most_far") <= apart)
    pairs = _cross(few, "key", top.select("key", "top"), near_enough, percent)

    crowd = named.join(top.where(F.col("across") > _CROWDED * F.col("rows")).select("key"), "key").select("x", "component").distinct()
    crowd = materialize(crowd.join(about, "x"), "crowd")
    if not crowd.isEmpty():
        rare = materialize(_rare_first(crowd, base, shingle, percent), "rare").join(crowd, "x")
        pairs = pairs.unionByName(_cross(rare, "e", _top(rare, "e").select("e", "top"), F.lit(True), percent))
    pairs = _bounded(pairs.distinct(), kind, percent).where("may_link").select("a", "b")
    pairs = materialize(pairs.join(checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    final = first
    if not pairs.isEmpty():
        more = materialize(_verify(pairs, base, shingle, percent).where("linked").select("a", "b"), "links")
        if not more.isEmpty():
            final = materialize(components(links.unionByName(more)), "components")

    found = member.select("doc_id", F.col("cls").alias("node")).join(final, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    return sets.select("doc_id", "n_shingles").join(_vertices(found), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _vertices(found: DataFrame) -> DataFrame:
    """(doc_id, component_id) from (doc_id, component): a doc_id of several components makes them one."""
    span = found.groupBy("doc_id").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    ties = materialize(found.join(span.where("component <> other").select("doc_id"), "doc_id", "left_semi"), "ties")
    if ties.isEmpty():
        return span.select("doc_id", F.col("component").alias("component_id"))
    lowest = ties.groupBy("doc_id").agg(F.min("component").alias("a"))
    joined = components(ties.join(lowest, "doc_id").select("a", F.col("component").alias("b")))
    return span.join(joined.withColumnRenamed("component", "whole"), F.col("component") == F.col("node"), "left").select("doc_id", F.coalesce("whole", "component").alias("component_id"))


def _buckets(base: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(key, doc_id, rep) of all buckets with two members or more; rep is the smallest member.

    Hot buckets are found in a sample of the documents, which steers the work and decides no result: their rows are dealt
    out over parts, whose representatives are brought together by a broadcast of a row per hot key."""
    kind = "key long, doc_id long"
    sample = materialize(base.mapInArrow(_keys(shingle, percent, frozenset(), _SAMPLE), kind).groupBy("key").count(), "sample")
    total = sample.agg(F.sum("count")).first()[0] or 0
    # fewer than 1/_HOT_SHARE keys can each hold more than that share: a proven bound on what comes to the driver
    hot = frozenset(r.key for r in sample.where(F.col("count") > max(16, total * _HOT_SHARE)).select("key").collect())
    discard(sample)
    rows = base.mapInArrow(_keys(shingle, percent, hot), kind)
    w = Window.partitionBy("key")
    part = F.shiftright("key", 48)
    rows = rows.select("key", "doc_id", F.min("doc_id").over(w).alias("rep"), F.count("*").over(w).alias("n")).where((F.col("n") > 1) | (part > 0)).drop("n")
    if not hot:
        return rows
    rows = materialize(rows, "parts")
    whole = F.col("key").bitwiseAND((1 << 48) - 1).alias("key")
    loud = F.broadcast(rows.where(part > 0).select(whole, "rep").groupBy("key").agg(F.min("rep").alias("least")))
    return rows.select(whole, "doc_id", "rep").join(loud, "key", "left").select("key", "doc_id", F.coalesce("least", "rep").alias("rep"))
