"""Spelling variants against brute force: near words, forms and roots, on the given texts and on words that share all grams."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loadlens.llm import queries, spelling_variants
from loadlens.llm.spelling_variants import decompose, group_variants, near_words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def near_by_force(words):
    """Pairs at distance one: one word is the other less a letter, or both give the same less the letter at one place."""
    near, less = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            less[i, short].append(w)
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for group in less.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def variants_by_force(rows, least=7, occurrences=2, ratio=10, every=0):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}
    near, form = near_by_force(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_spelling_variants(spark, SF).collect()
    assert {r.word: tuple(r) for r in got} == variants_by_force(docs, every=31) and len(got) == len({r.word for r in got})


@pytest.mark.parametrize("dictionary", [400_000, 8])
def test_words_that_share_most_grams(spark, monkeypatch, dictionary):
    """Hundreds of words with common beginnings and ends, and words of one letter, which an edit can rob of every gram."""
    monkeypatch.setattr(spelling_variants, "_DICTIONARY", dictionary)
    words = {"a" * k for k in range(7, 30)} | {"ab" * k for k in range(4, 9)} | {"a" * k + "b" + "a" * j for k in range(9) for j in range(7 - min(k, 7), 4)}
    words |= {f"inter{chr(97 + i)}{chr(97 + j)}ations" for i in range(20) for j in range(20)} | {"éééééééé", "ééééééé", "éééèéééé", "intercçations"}
    rows = [(w, i + 2) for i, w in enumerate(sorted(words))]
    got = near_words(spark.createDataFrame(rows, "word string, n long")).collect()
    force = near_by_force(words)
    assert {(r.x, r.y) for r in got} == {(w, x) for w, near in force.items() for x in near if w < x} and len(got) == len({(r.x, r.y) for r in got})


def test_an_edit_affects_at_most_the_bound():
    common = {g: 99 for g in ("^a", "ab", "ba", "aba", "abab", "ra")}
    for word, edited in (("abababa", "ababab"), ("abracadabra", "abracadxbra"), ("abracadabra", "abracadaabra"), ("aaaaaaa", "aaaaaaaa")):
        (grams, bound), (other, bound_of_other) = decompose(word, common), decompose(edited, common)
        shared = {g for g, _ in grams} & {g for g, _ in other}
        assert len(shared) >= max(len({g for g, _ in grams}) - bound, len({g for g, _ in other}) - bound_of_other)


def test_forms_lead_to_the_last(spark):
    rows = [(1, "lantern " * 2000 + "lanterns " * 200 + "lanternst " * 20 + "Lanternsts " * 2), (2, None), (None, "harvest harvest HARVEST"), (3, ""), (3, "harvesk harvesk"), (4, "÷harvest×harvest")]
    got = {r.word: tuple(r) for r in group_variants(spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).withColumn("word", F.lit("clash"))).collect()}
    assert got == variants_by_force(rows) and got["lanternsts"][2] == "lantern" and got["harvest"][4] == 1


def test_no_words(spark):
    assert group_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert group_variants(spark.createDataFrame([(1, None), (2, "a b c")], DOCS)).count() == 0


def test_repeated_rows_and_long_texts(spark):
    rows = [(7, "word" + "s" * 200_000), (7, "word" + "s" * 200_000), (8, "planets " * 100_000 + "planet's")]
    got = {r.word: tuple(r) for r in group_variants(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {**{"word" + "s" * 200_000: ("word" + "s" * 200_000, None, "word" + "s" * 200_000, 2, 0, None)}, "planets": ("planets", None, "planets", 100_000, 0, None)}
