"""The pipeline stage by stage against brute force, on a small table."""

import re
from collections import Counter

import corpus_pipeline
from loadlens.llm import edit_decontam
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic, near, leaks, mix, shard = (f for _, f in corpus_pipeline.STAGES)

    kept = toxic(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() <= docs.count()

    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert {r.doc_id for r in near(spark, docs, SF).collect()} == {i for i in ids if root(i) == i}

    items = [edit_decontam.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in leaks(spark, docs, SF).collect()}
    for r in docs.collect():
        if any(i in edit_decontam.normalise(r.text) for i in items):
            assert r.doc_id not in clean
    assert len(clean) > 0.5 * len(ids)

    mixed = mix(spark, docs, SF)
    size = Counter({s: 0 for s in {r.source for r in docs.collect()}})
    for r in mixed.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    assert mixed.columns == docs.columns and sum(size.values()) > 0

    placed = shard(spark, docs, SF)
    assert Counter(r.doc_id for r in placed.collect()) == Counter(ids)
    assert placed.where("shard is null").count() == 0


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_take_odd_and_empty_rows(spark):
    """Nulls in every column, blank texts, repeated rows and ids, and a column that clashes: each stage row by row."""
    same = "the quick brown fox jumps over the lazy dog and runs away"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, same, "en", "b", 1), (None, same + " again", "en", "b", 1), (3, same, "en", "b", 1), (3, "something else that is said in quite other words than that", "en", "b", 1), (None, " \t", None, None, None)], KIND).withColumn("times", F.lit(9)).withColumn("__row", F.lit("clash"))
    toxic, near, leaks, mix, shard = (f for _, f in corpus_pipeline.STAGES)
    plain = rows_of(odd.select(*corpus_pipeline.COLUMNS))
    assert rows_of(toxic(spark, odd, SF)) == plain and rows_of(leaks(spark, odd, SF)) == plain
    kept = rows_of(near(spark, odd, SF))
    gone = [r for r in plain if r[1] and r[1].startswith("the quick")]
    assert len(kept) == len(plain) - 2 and (3, same, "en", "b", 1) in kept and sorted(map(str, set(plain) - set(kept))) == sorted(str(r) for r in gone if r[0] is None)
    assert all(r[0] in (1, 2, 3, None) for r in rows_of(mix(spark, odd, SF))) and all(r[1] and r[1].strip() for r in rows_of(mix(spark, odd, SF)))
    assert sorted(str(r.doc_id) for r in shard(spark, odd, SF).collect()) == sorted(str(r[0]) for r in plain)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_leaking_rows_go_by_row(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if r.text)
    rows = [(None, "so " + item, "en", "a", 1), (7, "so " + item, "en", "a", 1), (7, "a clean row that shares its id", "en", "a", 1), (None, "clean too", "en", "a", 1)]
    kept = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, KIND), SF)
    assert rows_of(kept) == sorted(rows[2:], key=str)


def test_mix_of_shared_ids_meets_its_target(spark):
    rows = [(None, f"w{i} " * (1 + i % 7), "en", "a", 1) for i in range(400)] + [(5, "one two three", "en", "a", 1)] * 200 + [(i, "x y", "en", "b", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, KIND)
    words = Counter()
    for r in docs.collect():
        words[r.source] += len(r.text.split())
    mixed = Counter()
    for r in corpus_pipeline.mix(spark, docs, SF).collect():
        mixed[r.source] += len(r.text.split())
    a = min(2 * words["a"], 1.5 * sum(words.values()) * 5 / 7)
    b = min(2 * words["b"], 1.5 * sum(words.values()) - a)
    assert abs(mixed["a"] - a) <= 10 and abs(mixed["b"] - b) <= 10
