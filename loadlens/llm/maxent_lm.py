"""Scoring texts by a hashed maximum-entropy language model with a class-factored softmax.

A token is predicted in three steps: its class, its slot in the class, and the word in the slot. Classes and slots are
softmaxes over sums of weight rows that features of the context pick by hash: for classes the classes of the three words
before and, skipping one, the word before the last; for slots the class with the two words before. The word in its slot
follows counts. The
commonest words have slots of their own; a slot of the tail shares out equal parts of a topic's tokens. Words too rare for
the dictionary that tasks hold share one slot, and what they and unknown words are worth comes from a join with the counts
of all words.

Counts cover all training tokens. Weights are learned by gradient steps in every task on its own documents, averaged over
tasks by how often each row was updated: once after an eighth of the documents, and again after the rest, so that each
training token makes one step. Log-linear biases start at the counts, so the untrained model is the unigram model.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import discard, materialize, small_batches

#: Classes, slots of a class, and topics that the classes are dealt out to.
_CLASSES, _SLOTS, _TOPICS = 32, 32, 8
#: Bits of a text's profile, texts that each race draws as centres to start from, and moves of the centres after that. Topics
#: decide which words share a class and nothing else.
_TOPIC_BITS, _DRAWN, _MOVES = 12, 12, 4
#: Words that a task holds with their slots; the least count that as many reach, as a power of two, is asked of them.
_HELD_WORDS = 200_000
#: Entries that a task counts before it passes them on, tokens of a gradient step, and the step's length.
_HELD, _STEP, _RATE = 600_000, 16_384, 1.0
#: Rows of the weight tables, by the number of training tokens: one for so many, as a power of two between bounds.
_TOKENS_A_ROW, _LEAST_BITS, _MOST_BITS = 512, 10, 16
#: Rows that travel together, and the share of documents of the first round.
_CHUNK, _FIRST_ROUND = 1024, 8
#: The end of a text, counted as a token; no word is empty.
END = b""
_START = 0x5BD1E995


def tokens(text: bytes | None) -> list[bytes]:
    """Words between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns, A to Z lower-cased, and the end."""
    return [*(text.lower().split() if text else ()), END]


def held_out(doc_id: str = "doc_id", of: int = 7, remainder: int = 2) -> Column:
    """A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of)) == remainder


def _texts(column) -> Iterator[bytes | None]:
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else None


# Topics


def _profile(words: Counter) -> np.ndarray:
    """Unit vector of the hashed words of a text, each by the root of its count."""
    at = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & ((1 << _TOPIC_BITS) - 1)
    v = np.bincount(at, np.sqrt(np.fromiter(words.values(), np.float64, len(words))), 1 << _TOPIC_BITS).astype(np.float32)
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pick, at, weight) from (pick, text): where the profile of a text is not 0, and what it is there."""
    for batch in batches:
        at, weight = [], []
        for text in _texts(batch.column(1)):
            v = _profile(Counter(tokens(text)))
            held = np.flatnonzero(v)
            at.append(held.astype(np.uint16).tobytes())
            weight.append(v[held].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(weight, pa.binary())], names=["pick", "at", "weight"])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)


def _dense(at: bytes, weight: bytes) -> np.ndarray:
    v = np.zeros(1 << _TOPIC_BITS, np.float32)
    v[np.frombuffer(at, np.uint16)] = np.frombuffer(weight, np.float32)
    return v


def _weighed(batch: pa.RecordBatch, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, weight, starts, some) of profiles side by side, weighted by rare words to length 1; some: those with any such word."""
    parts = batch.column(1).to_pylist()
    sizes = np.array([len(p) for p in parts]) // 2
    at, starts = np.frombuffer(b"".join(parts), np.uint16), np.cumsum(sizes) - sizes  # no text is without its end
    weight = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32) * rare[at]
    length = np.sqrt(np.add.reduceat(weight * weight, starts))
    return at, weight / np.repeat(np.maximum(length, 1e-9), sizes), starts, length > 1e-6


def _nearness(at: np.ndarray, weight: np.ndarray, starts: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.add.reduceat(c[at] * weight, starts) for c in centres], axis=1)


def _drawn(centres: np.ndarray, rare: np.ndarray):
    """(key, pick, at, weight): of a task's different texts the first in a race that a text wins the more often the farther it
    is from all centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            picks = np.asarray(batch.column(0))
            at, weight, starts, some = _weighed(batch, rare)
            far = np.clip(1 - _nearness(at, weight, starts, centres).max(axis=1), 0, 1) if len(centres) else np.ones(len(starts))
            x = (picks.astype(np.uint64) ^ np.uint64(len(centres))) * np.uint64(0x9E3779B97F4A7C15)
            u = (((x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            key = -np.log(u) / np.maximum(far, 1e-30)
            ok = np.flatnonzero(some & (far > 1e-6))
            one = ok[np.unique(picks[ok], return_index=True)[1]]
            for i in one[key[one].argsort(kind="stable")[:_DRAWN]]:
                best[int(picks[i])] = (float(key[i]), batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
            best = dict(sorted(best.items(), key=lambda b: (b[1][0], b[0]))[:_DRAWN])
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best.values()], pa.float64()), pa.array(list(best), pa.int64()), pa.array([b[1] for b in best.values()], pa.binary()), pa.array([b[2] for b in best.values()], pa.binary())], names=["key", "pick", "at", "weight"])

    return run


_SUMS = "centre int, task int, n long, total binary"


def _sums(n: np.ndarray, total: np.ndarray, task: int) -> pa.RecordBatch:
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), task, np.int32)), pa.array(n[some].astype(np.int64)), pa.array([total[k].tobytes() for k in some], pa.binary())], names=["centre", "task", "n", "total"])


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_sums of a task's texts, all under one number: how many texts hold each hashed word."""
    n, total = np.zeros(1, np.int64), np.zeros((1, 1 << _TOPIC_BITS))
    for batch in batches:
        n += batch.num_rows
        total[0] += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16), minlength=1 << _TOPIC_BITS)
    yield _sums(n, total, TaskContext.get().partitionId())


def _gathered(centres: np.ndarray, rare: np.ndarray):
    """_sums of a task's texts by the centre that is nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), 1 << _TOPIC_BITS))
        for batch in batches:
            if not batch.num_rows:
                continue
            at, weight, starts, some = _weighed(batch, rare)
            own = _nearness(at, weight, starts, centres).argmax(axis=1)
            n += np.bincount(own[some], minlength=len(centres))
            place = np.repeat(own << _TOPIC_BITS, np.diff(np.append(starts, len(at)))) + at
            total += np.bincount(place, weight, total.size).reshape(total.shape)
        yield _sums(n, total, TaskContext.get().partitionId())

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of tasks added up by centre, one row for each."""
    n, total = Counter(), {}
    for batch in batches:
        for row in batch.to_pylist():
            n[row["centre"]] += row["n"]
            total[row["centre"]] = total.get(row["centre"], 0) + np.frombuffer(row["total"])
    for k, t in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([n[k]], pa.int64()), pa.array([t.tobytes()], pa.binary())], names=["centre", "task", "n", "total"])


def _summed(sums: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    placed = sums.repartition("centre").sortWithinPartitions("centre", "task")
    return {r.centre: (r.n, np.frombuffer(r.total)) for r in placed.mapInArrow(_added, _SUMS).collect()}  # a row for each centre


def _merged(sums: np.ndarray) -> np.ndarray:
    """Centres of up to _TOPICS groups of groups of texts, each given by its sum."""
    size, x = np.sqrt((sums * sums).sum(axis=1)), _unit(sums)
    at = [int(size.argmax())]
    near = x @ x[at[0]]
    while len(at) < min(_TOPICS, len(x)):
        at.append(int((size * (1 - near)).argmax()))
        near = np.maximum(near, x @ x[at[-1]])
    centres = x[at]
    for _ in range(_MOVES):
        own = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.array([sums[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))]))
    return centres


def topics(train: DataFrame) -> np.ndarray:
    """Centres of up to _TOPICS groups of all texts of train: rows, weighted against words that most texts hold.

    Texts become sparse profiles once. Two races over all of them draw where to start, all texts go to the nearest of these, the
    groups are merged, and all texts move the centres that are left."""
    profiles = materialize(train.select(F.xxhash64("text").alias("pick"), F.col("text").cast("binary").alias("text")).mapInArrow(_profiled, "pick long, at binary, weight binary"), "profiles")
    n, holders = _summed(profiles.mapInArrow(_holders, _SUMS)).get(0, (0, np.zeros(1 << _TOPIC_BITS)))
    rare = np.log((1 + n) / (1 + holders)).astype(np.float32)
    centres = np.zeros((0, 1 << _TOPIC_BITS), np.float32)
    for _ in range(2):
        first = profiles.mapInArrow(_drawn(centres, rare), "key double, pick long, at binary, weight binary").dropDuplicates(["pick"]).orderBy("key", "pick").limit(_DRAWN).collect()
        centres = np.concatenate([centres, *(_unit(_dense(r["at"], r.weight)[None] * rare) for r in first)])
    if len(centres):
        centres = _merged(np.array([total for _, total in _summed(profiles.mapInArrow(_gathered(centres, rare), _SUMS)).values()]))
        for _ in range(_MOVES):
            moved = _summed(profiles.mapInArrow(_gathered(centres, rare), _SUMS))
            centres = _unit(np.array([moved[k][1] if k in moved else centres[k] for k in range(len(centres))]))
    else:  # no text, or texts of the same words
        centres = np.zeros((1, 1 << _TOPIC_BITS), np.float32)
    discard(profiles)
    return centres * rare


# Counts


def _count(centres: np.ndarray):
    """(word, topic, n) of some documents' tokens."""

    def emit(counts: list[Counter]) -> pa.RecordBatch:
        words = [w for c in counts for w in c]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]).astype(np.int32)), pa.array([n for c in counts for n in c.values()], pa.int64())], names=["word", "topic", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in centres]
        for batch in batches:
            for text in _texts(batch.column(0)):
                words = Counter(tokens(text))
                counts[int((centres @ _profile(words)).argmax())].update(words)
                if sum(map(len, counts)) >= _HELD:
                    yield emit(counts)
                    counts = [Counter() for _ in centres]
        yield emit(counts)

    return run


# The model


class _Ids(dict):
    """Word to number: that of its row in the dictionary, or one by hash from past its end for other words."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + (zlib.crc32(word) & 0xFFFFFF)


@dataclass
class Model:
    """words: rows of the dictionary; slot and logs: their slots, and log10 of their parts of it; base: their base scores."""

    words: list[bytes]
    slot: np.ndarray
    logs: np.ndarray
    base: np.ndarray
    known: int
    vocabulary: int
    rare: int
    rare_words: int
    class_bias: np.ndarray
    slot_bias: np.ndarray
    bits: int
    classes: np.ndarray | None = None
    slots: np.ndarray | None = None

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((1 << self.bits, _CLASSES), np.float32), np.zeros((1 << self.bits, _SLOTS), np.float32)

    def ids(self) -> _Ids:
        return _Ids(zip(self.words, range(len(self.words)), strict=True))

    def features(self, ids: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Hashes of the contexts of the tokens of some texts, side by side, the last one for slots; and the tokens' slots."""
        all_, starts = np.concatenate(ids), np.cumsum([0, *map(len, ids)])[:-1]
        slot = self.slot_of(all_)

        def shifted(x: np.ndarray, first: int) -> np.ndarray:
            out = np.empty_like(x)
            out[1:] = x[:-1]
            out[starts] = first
            return out

        mix = lambda x, k: (x + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        before = shifted(all_.astype(np.uint64), _START)
        one, skip = mix(before, 1), mix(shifted(before, _START), 2)
        first = shifted((slot // _SLOTS + 1).astype(np.uint64), 0)
        second = shifted(first, 0)
        kinds = first + (second << np.uint64(8)) + (shifted(second, 0) << np.uint64(16))
        return [skip, mix(kinds, 4), mix(one ^ (skip >> np.uint64(7)), 3)], slot

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.uint16)  # short numbers are sorted by their digits

    def slot_of(self, ids: np.ndarray) -> np.ndarray:
        """Words beyond the dictionary share the last slot."""
        return self.slot[np.minimum(ids, len(self.slot) - 1)]

    def steps(self, ids: list[np.ndarray]):
        """(rows of the class weights, rows of the slot weights, class, slot) of tokens of some texts, a bounded number at once."""
        hashes, slot = self.features(ids)
        for a in range(0, len(slot), _STEP):
            c, s = slot[a : a + _STEP] // _SLOTS, slot[a : a + _STEP] % _SLOTS
            part = [h[a : a + _STEP] for h in hashes]
            within = (part[-1] ^ (c.astype(np.uint64) << np.uint64(40))) * np.uint64(0xC2B2AE3D27D4EB4F)
            yield [self.rows(h) for h in part[:-1]], [self.rows(within)], c, s


def _logits(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    x = weights.take(rows[0], axis=0, mode="clip")
    for r in rows[1:]:
        x += weights.take(r, axis=0, mode="clip")
    x += bias
    x -= x.max(axis=1, keepdims=True)
    return x


def _learn(weights: np.ndarray, seen: np.ndarray, spread: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, target: np.ndarray) -> None:
    """One gradient step; rows whose gradients have been large move less."""
    p = np.exp(_logits(weights, rows, bias))
    p /= -p.sum(axis=1, keepdims=True)
    p[np.arange(len(target)), target] += 1
    for r in rows:
        order = r.argsort(kind="stable")
        sorted_ = r[order]
        begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        g, at = np.add.reduceat(p.take(order, axis=0, mode="clip"), begin, axis=0), sorted_[begin]
        spread[at] += np.einsum("ij,ij->i", g, g)
        seen[at] += np.diff(np.append(begin, len(r)))
        weights[at] += g * (_RATE / np.sqrt(1 + spread[at]))[:, None]


def _train(model: Model):
    """(kind, chunk, task, weights, seen): the weight rows that some documents have changed, by kind of table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, tables = model.ids().__getitem__, [t.copy() for t in (model.classes, model.slots)]
        seen, spread = [np.zeros(len(t), np.int64) for t in tables], [np.zeros(len(t), np.float32) for t in tables]

        def learn(texts: list[np.ndarray]) -> None:
            for outer, inner, c, s in model.steps(texts):
                _learn(tables[0], seen[0], spread[0], outer, model.class_bias, c)
                _learn(tables[1], seen[1], spread[1], inner, model.slot_bias[c], s)

        held, n = [], 0
        for batch in batches:
            for text in _texts(batch.column(0)):
                words = tokens(text)
                held.append(np.fromiter(map(ids_of, words), np.int64, len(words)))
                n += len(words)
                if n >= _STEP:
                    learn(held)
                    held, n = [], 0
        if held:
            learn(held)
        for kind, (t, k) in enumerate(zip(tables, seen, strict=True)):
            for a in range(0, len(t), _CHUNK):
                if (part := k[a : a + _CHUNK]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([a // _CHUNK], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([t[a : a + _CHUNK].tobytes()]), pa.array([part.tobytes()])], names=["kind", "chunk", "task", "weights", "seen"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, chunk, weights) from rows sorted by kind and chunk: each weight row's mean over tasks, by its updates in each."""
    at, total, times = None, None, None

    def emit() -> pa.RecordBatch:
        mean = (total / np.maximum(times, 1)[:, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([mean.tobytes()]), pa.array([times.tobytes()])], names=["kind", "chunk", "weights", "seen"])

    for batch in batches:
        for row in batch.to_pylist():
            seen = np.frombuffer(row["seen"], np.int64)
            weights = np.frombuffer(row["weights"], np.float32).reshape(len(seen), -1).astype(np.float64) * seen[:, None]
            if at != (row["kind"], row["chunk"]):
                if at is not None:
                    yield emit()
                at, total, times = (row["kind"], row["chunk"]), weights, seen.copy()
            else:
                total, times = total + weights, times + seen
    if at is not None:
        yield emit()


def _slots(words: list[tuple[bytes, int, int]]) -> np.ndarray:
    """The slots of the dictionary's words (word, n, topic), by falling n: each topic's words are dealt out to its slots so that
    slots have equal parts of what is left, a common word one of its own. The last slot is left for all other words."""
    slot = np.zeros(len(words) + 1, np.int64)
    slot[-1] = _CLASSES * _SLOTS - 1
    each = _CLASSES // _TOPICS * _SLOTS
    for topic in range(_TOPICS):
        mine = [i for i, w in enumerate(words) if w[2] == topic]
        k, most, left, filled = 0, each - (topic == _TOPICS - 1), sum(words[i][1] for i in mine), 0
        for i in mine:
            if filled and k < most - 1 and filled + words[i][1] / 2 > left / (most - k):
                left, filled, k = left - filled, 0, k + 1
            slot[i] = topic * each + k
            filled += words[i][1]
    return slot


def _fit(train: DataFrame, words: DataFrame, counted) -> Model:
    levels = [1 << i for i in range(40)]
    sizes = words.agg(*(F.count_if(F.col("n") >= t) for t in levels)).first()
    least = next(t for t, size in zip(levels, sizes, strict=True) if size <= _HELD_WORDS)
    held = sorted(((bytes(r.word), r.n, r.topic) for r in words.where(F.col("n") >= least).collect()), key=lambda w: (-w[1], w[0]))  # at most _HELD_WORDS
    slot = _slots(held)
    n, rare, rare_words = counted.n or 0, (counted.n or 0) - sum(w[1] for w in held), counted.v - len(held)
    sizes = np.bincount(slot, minlength=_CLASSES * _SLOTS) * 0.0 + np.bincount(slot[:-1], [w[1] for w in held], _CLASSES * _SLOTS)
    sizes[-1] = rare + rare_words + 1  # as if each were seen once more, and an unknown word once
    of = np.array([w[1] for w in held], np.float64)
    log = lambda x: np.log(np.maximum(x, 1e-30)).astype(np.float32)
    by_class = sizes.reshape(_CLASSES, _SLOTS)
    return Model(
        [w[0] for w in held], slot, np.append(np.log10(of / sizes[slot[:-1]]), 0.0), np.append(np.log10((of + 1) / (n + counted.v + 1)), 0.0), n, counted.v, rare, rare_words,
        log(by_class.sum(axis=1) / by_class.sum()), log(by_class / np.maximum(by_class.sum(axis=1, keepdims=True), 1e-30)), int(np.clip(np.log2(max(n, 1) / _TOKENS_A_ROW), _LEAST_BITS, _MOST_BITS)),
    )


def _rounds(train: DataFrame, model: Model) -> Model:
    spark = train.sparkSession
    model.classes, model.slots = model.empty()
    first = F.pmod(F.xxhash64("text"), F.lit(_FIRST_ROUND)) == 0
    tasks = max(2, 2 * spark.sparkContext.defaultParallelism)
    for part in (train.where(first), train.where(~first)):
        moved = part.select(F.col("text").cast("binary")).coalesce(tasks).mapInArrow(_train(model), "kind int, chunk int, task int, weights binary, seen binary")
        chunks = moved.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "kind", "chunk").sortWithinPartitions("kind", "chunk", "task")
        mean = materialize(chunks.mapInArrow(_average, "kind int, chunk int, weights binary, seen binary"), "weights")
        tables = [model.classes.copy(), model.slots.copy()]
        for r in mean.collect():  # the model, whose size is bounded
            seen = np.frombuffer(r.seen, np.int64) > 0
            a = r.chunk * _CHUNK
            tables[r.kind][a : a + len(seen)][seen] = np.frombuffer(r.weights, np.float32).reshape(len(seen), -1)[seen]
        model.classes, model.slots = tables
        discard(mean)
    return model


def _lists(counts: list[Counter]) -> pa.ListArray:
    """For each text the words that it counts, as a list of (word, times)."""
    words, times = pa.array([w for c in counts for w in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, counts)]), pa.int32()), pa.StructArray.from_arrays([words, times], ["word", "times"]))


def _score(model: Model):
    """(key, doc_id, held_out, n_tokens, n_known, base, score, rare) for each document, without what rare words are worth."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, size, number = model.ids(), len(model.words), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, rare, hot = [], [], []
            for text in _texts(batch.column(2)):
                words = tokens(text)
                ids = np.fromiter(map(ids_of.__getitem__, words), np.int64, len(words))
                texts.append(ids)
                outside = np.flatnonzero(ids >= size)
                rare.append(Counter([words[i] for i in outside]))
                hot.append(len(words) - len(outside))
            ends = np.cumsum([0, *map(len, texts)])[:-1]
            parts = []
            done, held = 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= 8 * _STEP or i == len(texts) - 1:
                    for outer, inner, c, s in model.steps(texts[done : i + 1]):
                        each = np.arange(len(c))
                        x, y = _logits(model.classes, outer, model.class_bias), _logits(model.slots, inner, model.slot_bias[c])
                        parts.append((x[each, c] - np.log(np.exp(x).sum(axis=1)) + y[each, s] - np.log(np.exp(y).sum(axis=1))).astype(np.float64) / np.log(10))
                    done, held = i + 1, 0
            if not texts:
                continue
            at = np.minimum(np.concatenate(texts), size)
            score, base = np.add.reduceat(np.concatenate(parts) + model.logs[at], ends), np.add.reduceat(model.base[at], ends)
            yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(texts))), batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(hot, pa.int64()), pa.array(base), pa.array(score), _lists(rare)], schema=schema)
            number += len(texts)

    return run


def score_texts(docs: DataFrame, is_held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    The model learns from the rows that are not held out. base_score is the sum of log10((c + 1) / (N + V + 1)) over the tokens,
    score the model's log10 probability of the text; both take all unknown words as one. A null text is an empty one, which
    is its end alone; repeated rows and ids are rows of their own, and count as often as they occur; other columns are
    ignored; an empty table gives an empty table, and without training rows any text has probability 1."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(is_held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    with small_batches(docs.sparkSession, 4_000_000):
        counted = train.select(F.col("text").cast("binary")).mapInArrow(_count(topics(train)), "word binary, topic int, n long")
        by_topic = F.array(*(F.coalesce(F.sum(F.when(F.col("topic") == k, F.col("n"))), F.lit(0)) for k in range(_TOPICS)))
        words = counted.groupBy("word").agg(F.sum("n").alias("n"), by_topic.alias("in"))
        words = materialize(words.select("word", "n", (F.array_position("in", F.array_max("in")) - 1).cast("int").alias("topic")), "words")
        model = _rounds(train, _fit(train, words, words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()))
        found = rows.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(_score(model), "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, times: long>>")
        found = materialize(found, "scored")
    rare = found.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.times")
    seen = F.coalesce("n", F.lit(0)) + 1
    worth = rare.join(words.select("word", "n"), "word", "left").groupBy("key").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"), F.sum(F.col("times") * F.log10(seen / (model.known + model.vocabulary + 1))).alias("rare_base"),
        F.sum(F.col("times") * F.log10(seen / (model.rare + model.rare_words + 1))).alias("rare_score"),
    )
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return found.drop("rare").join(worth, "key", "left").select("doc_id", "held_out", "n_tokens", add("n_known", "rare_known").alias("n_known"), F.lit(model.known).cast("long").alias("train_tokens"), add("base", "rare_base").alias("base_score"), add("score", "rare_score").alias("score"))
