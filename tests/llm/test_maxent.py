"""Language-model scores: the base and counts against brute force, probabilities that sum to 1, and held-out texts that gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.llm import maxent_lm, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [""]


def base_by_force(rows):
    out_of = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not out_of(d) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    return sorted(((d if d is not None else -1, out_of(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in rows for w in [words_of(t)]), key=str)


def base_of(found):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=str)


def test_query_base_and_gain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_lm_scores(spark, SF).collect()
    assert base_of(got) == base_by_force(docs)
    assert all(r.score < 0 for r in got)
    for side in (True, False):
        assert sum(r.score for r in got if r.held_out == side) > sum(r.base_score for r in got if r.held_out == side)


def test_rare_words_join_their_counts(spark, monkeypatch):
    """With a dictionary of a few words nearly all go through the join, to the same base."""
    monkeypatch.setattr(maxent_lm, "_HELD_WORDS", 5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    got = maxent_lm.score_texts(spark.createDataFrame(rows, DOCS), maxent_lm.held_out()).collect()
    assert base_of(got) == base_by_force(rows)


@pytest.mark.parametrize("held", [200_000, 20])
def test_probabilities_sum_to_one(spark, monkeypatch, held):
    """Over classes, over the slots of a class, and over the words of a slot, in the last of which one part is an unknown word's."""
    monkeypatch.setattr(maxent_lm, "_HELD_WORDS", held)
    rows = [(d, f"the cat {d % 3} sat on the mat and the dog {d % 5} ate") for d in range(40)]
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in words_of(t))
    model = {}
    keep = maxent_lm._rounds
    monkeypatch.setattr(maxent_lm, "_rounds", lambda train, m: model.setdefault("m", keep(train, m)))
    maxent_lm.score_texts(spark.createDataFrame(rows, DOCS), maxent_lm.held_out())
    m = model["m"]
    ids = m.ids()
    slots = np.bincount(m.slot[:-1], 10 ** m.logs[:-1], maxent_lm._CLASSES * maxent_lm._SLOTS)
    assert np.allclose(slots[slots > 0], 1)
    rare = [n for w, n in counts.items() if w.encode() not in set(m.words)]
    assert (sum(rare), len(rare)) == (m.rare, m.rare_words) and math.isclose(sum(n + 1 for n in rare) + 1, m.rare + m.rare_words + 1)
    text = np.array([ids[w] for w in (b"the", b"cat")])
    for outer, inner, c, s in m.steps([text]):
        for weights, at, bias in ((m.classes, outer, m.class_bias), (m.slots, inner, m.slot_bias[c])):
            p = np.exp(maxent_lm._logits(weights, at, bias))
            assert np.isfinite(p).all() and (p.sum(axis=1) > 0).all() and np.isfinite(weights).all()


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "alpha beta"), (3, " \t\n "), (4, "Alpha BETA gamma"), (4, "Alpha BETA gamma"), (5, "alpha " * 200_000), (6, "é à alpha"), (16, "omega   alpha beta")]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("key", "word", "n", "base", "rare", "topic", "held_out", "score"):
        df = df.withColumn(c, F.lit("clash"))
    got = maxent_lm.score_texts(df, maxent_lm.held_out()).collect()
    assert base_of(got) == base_by_force(rows)
    assert len({r.score for r in got if r.doc_id == 4}) == 1


def test_empty_and_untrained(spark):
    assert maxent_lm.score_texts(spark.createDataFrame([], DOCS), maxent_lm.held_out()).count() == 0
    got = maxent_lm.score_texts(spark.createDataFrame([(1, "a b")], DOCS), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] and abs(got[0].score) < 1e-6


def test_scores_do_not_depend_on_held_out_texts(spark):
    """Held-out texts teach nothing: other held-out texts leave a score as it is."""
    train = [(d, f"one two three {d % 4} five six") for d in range(200) if zlib.crc32(str(d).encode()) % 7 != 2]
    out = [d for d in range(1000, 1100) if zlib.crc32(str(d).encode()) % 7 == 2]
    score = lambda rows: {r.doc_id: round(r.score, 5) for r in maxent_lm.score_texts(spark.createDataFrame(rows, DOCS).coalesce(1), maxent_lm.held_out()).collect()}
    a = score(train + [(out[0], "one two three")])
    b = score(train + [(out[0], "one two three"), (out[1], "three two one zero " * 50)])
    assert a[out[0]] == b[out[0]]


def test_topics_are_of_all_training_texts(spark, monkeypatch):
    """Groups of texts without a common word share no centre, however few their texts are, and no bound on texts steers that."""
    monkeypatch.setattr(maxent_lm, "TOPIC_DOCS", 1, raising=False)
    groups = {"a": 150, "b": 40, "c": 3}
    texts = [(g, " ".join(f"{g}{(i * 7 + j) % 11}" for j in range(30))) for g, n in groups.items() for i in range(n)]
    taken = {}
    monkeypatch.setattr(maxent_lm, "_count", lambda centres, of=maxent_lm._count: taken.setdefault("centres", centres) is not None and of(centres))
    maxent_lm.score_texts(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(9000, None), (9001, "")], DOCS), F.lit(False))
    own = {g: {int((taken["centres"] @ maxent_lm._profile(Counter(maxent_lm.tokens(t.encode())))).argmax()) for h, t in texts if h == g} for g in groups}
    assert len(taken["centres"]) > 3 and sum(map(len, own.values())) == len(set().union(*own.values()))
