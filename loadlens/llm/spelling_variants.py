"""Grouping of spelling variants with a variable-length gram index.

Words are framed by a start and an end sign. A dictionary of frequent grams is read off all words: a gram that more than a
threshold of positions hold is extended by the next letter, one that fewer hold is not. So each position of a word has one
gram, the shortest that is rare or as long as grams may get, and the grams of the dictionary are free of prefixes: whether a
gram stands at a position is told by its own letters alone. An edit of one letter therefore affects only the grams that
cover the letter, and the most that cover one letter is the word's affected-gram bound. Two words at distance one share all
grams of either but at most its bound, so the first of their common grams in a fixed order is among the first bound + 1 of
both. Only these are indexed; words that meet on one, at fitting positions and lengths, are verified exactly.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import discard, materialize, small_batches

RUN = r"[A-Za-zÀ-ÿ]+"
#: Signs of a word's start and end; no word holds them.
_START, _END = "^", "$"
#: Shortest and longest grams of the dictionary.
_SHORT, _LONG = 2, 6
#: A gram at more positions than this is extended. The least threshold is tried first; it is doubled until the dictionary
#: has at most _DICTIONARY grams to extend, so that tasks can hold it. It steers the work and decides no result.
_COMMON, _DICTIONARY = 24, 400_000
#: Entries that a task counts before it passes them on.
_HELD = 300_000


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])


def _read_words(least: int, delete_every: int):
    """(key, n): words of at least so many letters in some documents; runs whose checksum delete_every divides lose a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts = re.compile(RUN).findall, Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # lower() of bytes changes A to Z alone
                for word, n in Counter(runs(text.as_buffer().to_pybytes().lower().decode())).items():
                    h = zlib.crc32(word.encode(), head) if delete_every else 1
                    if delete_every and h % delete_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) >= _HELD:
                    yield _counted(counts)
                    counts.clear()
        if counts:
            yield _counted(counts)

    return run


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): positions of some words at which a gram of any length stands."""
    counts = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            framed = _START + word + _END
            counts.update(framed[i:j] for i in range(len(framed) - 1) for j in range(i + _SHORT, min(i + _LONG, len(framed)) + 1))
            if len(counts) >= _HELD:
                yield _counted(counts)
                counts.clear()
    if counts:
        yield _counted(counts)


def decompose(word: str, common: dict[str, int]) -> tuple[list[tuple[str, int]], int]:
    """The grams of a word with their positions, and the most of them that one edit can affect.

    common: how many positions hold each gram that is to be extended."""
    framed = _START + word + _END
    end, grams, cover = len(framed), [], [0] * (len(framed) + 1)
    for i in range(end - 1):
        j = min(i + _SHORT, end)
        while j < end and j - i < _LONG and framed[i:j] in common:
            j += 1
        grams.append((framed[i:j], i))
        for k in range(i, j):
            cover[k] += 1
    return grams, max(cover)


def _index(common: dict[str, int]):
    """(gram, at, size, word, n, weak) for the rarest grams of each word, one more than an edit can affect. A weak word may
    lose all of its grams at once; it has no other mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, bound = decompose(word, common)
                names = sorted({g for g, _ in grams}, key=lambda g: (common.get(g, 0), g))
                weak, kept = len(names) <= bound, set(names[: bound + 1])
                out += [(g, i, len(word), word, n, weak) for g, i in grams if g in kept]
            if out:
                gram, at, size, word, n, weak = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(word), pa.array(n, pa.int64()), pa.array(weak)], names=["gram", "at", "size", "word", "n", "weak"])

    return run


def count_words(docs: DataFrame, least: int = 7, occurrences: int = 2, delete_every: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters of the whole texts, A to Z lower-cased, with at least so many code points and occurrences.

    Where delete_every is not 0, a run whose checksum with its document's id it divides first loses one code point. Null and
    empty texts have no words; a null id counts as an empty one; repeated rows count each; other columns are ignored."""
    counted = docs.select(doc_id, text).mapInArrow(_read_words(least, delete_every), "key string, n long")
    with small_batches(docs.sparkSession):
        return materialize(counted.groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences), "words")


def _halves(index: DataFrame, words: DataFrame) -> DataFrame:
    """Near pairs of weak words: of two words at distance one, one has the first or the second half of the other as a prefix or suffix."""
    weak = index.where("weak").select("word", "n", "size").distinct()
    half = F.floor(F.col("size") / 2).cast("int")
    parts = lambda df, size, half: df.select("word", "n", size.alias("whole"), F.explode(F.array(F.struct(F.lit("head").alias("part"), F.substring("word", F.lit(1), half).alias("key")), F.struct(F.lit("tail").alias("part"), F.expr("right(word, whole_ - half_)").alias("key")))).alias("k")).select("word", "n", "whole", "k.*")
    w = weak.withColumn("whole_", F.col("size")).withColumn("half_", half)
    o = words.withColumn("whole_", F.explode(F.array(*(F.char_length("word") + d for d in (-1, 0, 1))))).withColumn("half_", F.floor(F.col("whole_") / 2).cast("int"))
    a, b = parts(w, F.col("whole_"), F.col("half_")).alias("a"), parts(o, F.col("whole_"), F.col("half_")).alias("b")
    met = a.join(b, ["part", "key", "whole"]).where("a.word <> b.word and levenshtein(a.word, b.word, 1) = 1")
    first = F.col("a.word") < F.col("b.word")
    pick = lambda name, yes: F.when(first, F.col(f"{'a' if yes else 'b'}.{name}")).otherwise(F.col(f"{'b' if yes else 'a'}.{name}"))
    return met.select(pick("word", True).alias("x"), pick("n", True).alias("x_n"), pick("word", False).alias("y"), pick("n", False).alias("y_n"))


def near_words(words: DataFrame) -> DataFrame:
    """(x, x_n, y, y_n), x before y: the pairs of words that differ by one inserted, deleted or replaced code point.

    words: (word, n), distinct, materialized, and without the signs ^ and $. No pair is lost, however often its grams occur."""
    grams = words.select("word").mapInArrow(_count_grams, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > _COMMON)
    grams = materialize(grams, "grams")
    levels = [_COMMON << i for i in range(40)]
    sizes = grams.agg(*(F.count_if(F.col("n") > t) for t in levels)).first()
    common = next(t for t, size in zip(levels, sizes, strict=True) if size <= _DICTIONARY)
    extended = {r.key: r.n for r in grams.where(F.col("n") > common).collect()}  # at most _DICTIONARY
    discard(grams)
    index = materialize(words.select("word", "n").mapInArrow(_index(extended), "gram string, at int, size int, word string, n long, weak boolean"), "gram-index")
    a, b = index.alias("a"), index.alias("b")
    # what an edit leaves keeps its place from the start or from the end
    fits = "a.word < b.word and abs(a.size - b.size) <= 1 and (a.at = b.at or a.at - b.at = a.size - b.size) and levenshtein(a.word, b.word, 1) = 1"
    near = a.join(b, "gram").where(fits).select(F.col("a.word").alias("x"), F.col("a.n").alias("x_n"), F.col("b.word").alias("y"), F.col("b.n").alias("y_n"))
    if not index.where("weak").isEmpty():
        near = near.unionByName(_halves(index, words))
    return near.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form reached. Each form occurs several times as often as its word, so there are
    no circles and chains are as long as the logarithm of the largest count at most; pointers are doubled."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = up.alias("a").join(up.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        doubled = materialize(next_.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "roots")
        if doubled.where("moved").isEmpty():
            return up
        up = doubled.select("word", "root")


def group_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, ratio: int = 10, delete_every: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the documents.

    A word's form is the near word with the most occurrences (ties: the smallest in code-point order), if it occurs at least
    ratio times as often as the word, else null; root follows forms to the last. A table without words gives no rows. See
    count_words for odd input."""
    words = count_words(docs, least, occurrences, delete_every, doc_id, text)
    near = near_words(words)
    both = near.select(F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("x_n").alias("n"), F.col("y").alias("near"), F.col("y_n").alias("near_n")), F.struct(F.col("y").alias("word"), F.col("y_n").alias("n"), F.col("x").alias("near"), F.col("x_n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"), F.first("n").alias("own"))
    taken = -F.col("best.less") >= ratio * F.col("own")
    best = materialize(best.select("word", "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "forms")
    root = roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
