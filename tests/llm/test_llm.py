"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables.

Each operator also meets nulls in every column, empty and very long texts, ties and repeated rows, an empty table, and
extra columns whose names clash with those used inside.
"""

import hashlib
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.llm import chat_windows, ego_join, feistel_pii, nblr_toxicity, parity_join, resync_tokens, tier_compaction, zip_warc
from loadlens.llm import edit_decontam as leaks_of
from loadlens.llm.graph import components
from loadlens.llm.mixing import fit_counts, mix_sources
from loadlens.llm.parity_join import jaccard_components, shingle_hashes, sketch_keys

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def odd(spark, rows=()):
    """Documents with nulls, blanks, ties and repeated rows, and columns that clash."""
    base = [(1, "alpha beta gamma delta epsilon", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "de", "b", 3), (5, "alpha beta gamma delta epsilon", "en", "b", 1), (5, "alpha beta gamma delta epsilon", "en", "b", 1), (6, "one", "en", None, 3), (None, "alpha beta gamma delta epsilon", "en", "a", 1), *rows]
    df = spark.createDataFrame(base, DOCS)
    for c in ("key", "rep", "size", "cls", "component_id", "n_shingles", "taken", "target", "held_out_", "h"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def none(spark):
    return spark.createDataFrame([], DOCS)


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


# Components


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 30)] + [(29, 28), (5, 5), (7, 1), (200, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def digests(rows):
    out = {}
    for c, turns in rows.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def said(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_windows.read_back(df).collect()}


def test_chat_windows_round_trip(spark):
    turns = table(spark, "conversations")
    rows = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        rows[r.conv_id].append((r.role, r.text or ""))
    for budget, history in ((64, 0), (200, 2), (100_000, 1)):
        assert said(chat_windows.format_windows(turns, budget=budget, history=history)) == digests(rows)


def test_chat_windows_with_odd_turns(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\|im_start|>", "<|im_start|>system\nx<|im_end|>\n", "a\\<|im_end|>", "", "日本 🎉 <s>", "[\\INST]", "\n\n"]
    rows = [(7, i, r, t) for i, (r, t) in enumerate([("system", "be\nkind")] + [("user" if i % 2 else "assistant", t) for i, t in enumerate(nasty * 6)])]
    rows += [(8, 0, None, None), (8, 1, "as\nsis\\tant", "x"), (8, 1, "assistant", "tie b"), (8, 1, "assistant", "tie a"), (9, None, "user", "first"), (9, 0, "assistant", "w " * 5000)]
    want = defaultdict(list)
    for c, n, r, t in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", hashlib.sha256((x[3] or "").encode()).hexdigest())):
        want[c].append((r or "", t or ""))
    windows = chat_windows.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=60, history=2, block=4)
    assert said(windows) == digests(want)
    of7 = windows.where("conv_id = 7").orderBy("span").collect()
    assert len(of7) > 3 and all(w.text.startswith("<|im_start|>system\nbe\nkind") for w in of7) and all(w.repeated >= 1 for w in of7[1:])
    assert said(chat_windows.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))) == {}


def test_windows_keep_their_budget(spark):
    rows = [(1, i, "user", "w " * (i % 20)) for i in range(200)]
    df = chat_windows.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=100, history=0)
    for w in df.collect():
        n = w.text.count("<|im_start|>")
        assert len(re.findall(r"\bw\b", w.text)) + 4 * n <= 100


def test_windows_count_the_system_turn_and_history(spark):
    rows = [(1, 0, "system", "w " * 300)] + [(1, i, "user" if i % 2 else "assistant", "w " * (250 if i % 3 else 40)) for i in range(1, 40)]
    rows += [(2, 0, "system", "w " * 30)] + [(2, i, "assistant", "w " * (5000 if i == 5 else 60)) for i in range(1, 20)]
    rows += [(3, 0, "system", "w " * 600), (3, 1, "user", "w"), (3, 2, "assistant", "w w")] + [(None, i, "user", "w " * 200) for i in range(9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = chat_windows.format_windows(turns, history=2).cache()
    size = lambda w: len(re.findall(r"\bw\b", w.text)) + 4 * w.text.count("<|im_start|>")
    for w in df.collect():
        n = w.text.count("<|im_start|>")
        assert w.over_budget == (size(w) > 512)
        if w.over_budget:
            assert n - w.repeated == 1 and (w.repeated == 0 or w.repeated == 1 and w.text.startswith("<|im_start|>system"))
        if w.conv_id in (1, 2, 3) and w.first_place:
            assert w.text.startswith("<|im_start|>system")
    over = Counter(w.conv_id for w in df.collect() if w.over_budget)
    assert over == {1: 26, 2: 1, 3: 3}  # turns that do not fit beside the system turn
    assert max(w.repeated for w in df.where("conv_id = 2").collect()) == 3
    want = defaultdict(list)
    for c, _, r, t in rows:
        want[c].append((r, t))
    assert said(df) == digests(want)


# 2


def test_fit_counts_is_exact_where_sums_allow():
    rnd = random.Random(5)
    for _ in range(60):
        sizes = np.array(sorted(rnd.sample(range(1, 40), 6)))
        counts = np.array([rnd.randrange(1, 5) for _ in sizes])
        budget = rnd.randrange(0, int((sizes * counts).sum()) + 5)
        take = fit_counts(sizes, counts, budget, 10_000)
        assert (take >= 0).all() and (take <= counts).all() and int((sizes * take).sum()) <= budget
        sums = {0}
        for size, n in zip(sizes.tolist(), counts.tolist(), strict=True):
            sums = {x + k * size for x in sums for k in range(n + 1)}
        assert int((sizes * take).sum()) == max(x for x in sums if x <= budget)


def test_fit_counts_reaches_long_documents():
    one = np.ones(10, np.int64)
    for seed in range(20):
        for size, budget, fits in ((80_000, 100_000, 1), (60_000, 185_000, 3), (2_000_000, 9_000_000, 4)):
            assert fit_counts(size + np.arange(10), one, budget, 50_000, seed).sum() == fits
        for budget in (100_000, 2_000_000):  # long and short together
            sizes = np.r_[np.arange(1, 300), 60_000 + np.arange(30), 300_000]
            left = budget - int((sizes * (take := fit_counts(sizes, np.ones(330, np.int64), budget, 50_000, seed))).sum())
            assert take.max() == 1 and 0 <= left <= 2


def test_fit_counts_takes_unique_lengths_by_the_seed():
    sizes = np.unique(np.linspace(5, 6000, 481).astype(int))
    budget = int(0.3 * sizes.sum())
    takes = np.array([fit_counts(sizes, np.ones(len(sizes), np.int64), budget, 50_000, seed) for seed in range(100)])
    assert takes.max() == 1 and (takes @ sizes == budget).all()
    often = takes.mean(axis=0)
    assert 0.05 < often.min() and often.max() < 0.6  # every length has its chance
    assert all(0.2 < part.mean() < 0.4 for part in np.array_split(often, 4))  # short and long alike
    assert (fit_counts(sizes[::-1], np.ones(len(sizes), np.int64), budget, 50_000, 3)[::-1] == takes[3]).all()


def water(total, weights=(5, 2, 1), share=1.5):
    names = sorted((n for n in total if n is not None)) + ([None] if None in total else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full, want = set(), share * sum(total.values())
    while True:
        left, open_ = want - sum(2 * total[n] for n in full), sum(w[n] for n in names if n not in full)
        more = {n for n in names if n not in full and left * w[n] > 2 * total[n] * open_}
        if not more:
            return {n: 2.0 * total[n] if n in full else left * w[n] / open_ for n in names}
        full |= more


def test_mix_meets_its_targets(spark):
    docs = table(spark, "documents")
    total = Counter()
    for r in docs.collect():
        total[r.source] += len(WORD.findall(r.text or ""))
    rows = mix_sources(docs).collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r["size"] == 0 or r.taken % r["size"] == 0 and r.taken <= 2 * r["size"]
    want = water(total)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
    for n in total:
        assert abs(taken[n] - want[n]) <= 200
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_of_odd_rows(spark):
    df = odd(spark).drop("size", "taken", "target", "rep", "key")
    rows = mix_sources(df).collect()
    assert len(rows) == 8 and all(r.taken == 0 for r in rows if not r["size"])
    assert mix_sources(none(spark)).count() == 0


def test_mix_ranks_inside_a_hot_length(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2900, "a").otherwise("b").alias("source"))
    rows = mix_sources(docs, share=0.5, weights=(1.0,)).collect()
    got = Counter()
    for r in rows:
        got[r.source] += r.taken
    target = {r.source: r.target for r in rows}
    assert all(abs(got[s] - target[s]) <= 3 for s in target)


# 3


def classes(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    u = Union()
    items = sorted(sets)
    for x, i in enumerate(items):
        u.root(i)
        for j in items[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                u.join(i, j)
    return {i: (len(sets[i]), u.root(i)) for i in items}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, n, percent):
    rnd = random.Random(n)
    rows = []
    for group in range(25):
        length = rnd.choice([1, 3, 4, 5, 6, 8, 12, 20, 40, 90, 200])
        base = [f"w{rnd.randrange(400)}" for _ in range(length)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rnd.randrange(len(copy) + 1)
                copy[at : at + rnd.randrange(2)] = [f"x{rnd.randrange(50)}"]
            rows.append((len(rows) * 3 + 1, " ".join(copy).upper() if rnd.random() < 0.2 else "  ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert got == classes(rows, n, percent)


def test_jaccard_of_odd_rows(spark):
    df = odd(spark, [(9, "x " * 30_000, "en", "a", 1), (10, "X " * 30_000, "en", "a", 1)])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, 5, 80).collect()), key=str)
    assert got == sorted([(1, 1, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 1, 1), (5, 1, 1), (6, 1, 6), (None, 1, None), (9, 1, 9), (10, 1, 9)], key=str)
    assert jaccard_components(none(spark)).count() == 0


def test_jaccard_in_a_crowd_of_far_copies(spark, monkeypatch):
    """Many texts that are alike but not linked, with some that are, in the same buckets: through pairs and rarest shingles."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(100_000)}" for _ in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at in rnd.sample(range(120), rnd.choice([1, 3, 7, 8, 9, 10])):
            copy[at] = f"x{rnd.randrange(100_000)}"
        rows.append((i * 2, " ".join(copy)))
        if rnd.random() < 0.3:
            copy[rnd.randrange(120)] = "y"
            rows.append((i * 2 + 1, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows, 5, 80)
    assert 5 < len({c for _, c in want.values()}) < len(rows) - 5
    for crowded in (0.1, 4, 10**9):
        monkeypatch.setattr(parity_join, "_CROWDED", crowded)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, 5, 80).collect()} == want
    monkeypatch.setattr(parity_join, "_SAMPLE", 1)
    monkeypatch.setattr(parity_join, "_PARTS", 3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, 5, 80).collect()} == want


def test_jaccard_of_shared_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(200))
    rows = [(5, a), (5, b), (9, a + " z"), (10, b + " z"), (12, b), (20, "c d e f g h"), (20, a), (30, "c d e f g h")]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == dict.fromkeys((5, 9, 10, 12, 20, 30), 5)


def test_empty_pieces_make_no_keys():
    """Sets without a common element share no key, whatever their sizes."""
    rnd = random.Random(2)
    seen = Counter()
    with np.errstate(over="ignore"):
        for _ in range(1500):
            h = np.unique(np.array([rnd.getrandbits(64) for _ in range(rnd.choice([3, 4, 5, 6, 8, 11, 16, 25, 40, 70, 150]))], np.uint64))
            seen.update(set(sketch_keys(h, 80).tolist()))
    assert max(seen.values()) == 1


def test_linked_sets_share_a_key():
    rnd = random.Random(1)
    with np.errstate(over="ignore"):
        for percent in (80, 85):
            for size in (4, 5, 7, 10, 17, 30, 55, 90, 300, 1500):
                for _ in range(12):
                    base = np.array([rnd.getrandbits(64) for _ in range(size)], np.uint64)
                    most = int(size * (100 - percent) / 100)
                    drop = rnd.randrange(most + 1)
                    other = base[drop:]
                    add = 0
                    while 100 * len(other) >= percent * (size + add + 1) and rnd.random() < 0.9:
                        add += 1
                    other = np.concatenate([other, np.array([rnd.getrandbits(64) for _ in range(add)], np.uint64)])
                    if 100 * (size - drop) >= percent * (size + add):
                        a, b = np.sort(base), np.sort(other)
                        assert len(np.setxor1d(a, b)) == 0 or len(np.intersect1d(sketch_keys(a, percent), sketch_keys(b, percent))) > 0


def test_shingles_lower_ascii_only():
    with np.errstate(over="ignore"):
        cache = {w: hash(w) & ((1 << 64) - 1) for w in (b"a", "Ä".encode(), b"b", b"c")}
        assert (shingle_hashes("A Ä b\x0bC", 4, cache) == shingle_hashes("a  Ä\tB c ", 4, cache)).all()


# 4


def nearest(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def test_leaks_with_edits(spark):
    rnd = random.Random(9)
    items = [(i, "".join(rnd.choice("abcde fgh") for _ in range(rnd.choice([10, 19, 23, 30, 70, 150]))).strip() + "z") for i in range(12)]
    docs = []
    for n in range(80):
        k, text = rnd.choice(items)
        edited = list(text)
        for _ in range(rnd.randrange(int(len(text) * 0.16) + 1)):
            at = rnd.randrange(len(edited))
            edited[at : at + rnd.randrange(2)] = rnd.choice(["", "q", "r"])
        docs.append((n, "".join(rnd.choice("ijklm ") for _ in range(60)) + " " + "".join(edited).upper() + " \n " + "nop " * 20))
    want = set()
    for n, text in docs:
        plain = leaks_of.normalise(text)
        for k, item in items:
            item = leaks_of.normalise(item)
            if (d := nearest(item, plain)) <= int(len(item) * 0.1):
                want.add((n, k, d))
    got = leaks_of.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == want and len(want) > 20


def test_short_items_have_a_budget(spark):
    docs = spark.createDataFrame([(1, "so abcdefghXjklmnopqrst it is"), (2, "abXdefghXjklmnopqrst"), (3, "abc"), (4, "xabcx")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "abcdefghijklmnopqrst"), (2, "ABC")], "item_id long, text string")
    found = lambda **o: {(r.doc_id, r.item_id, r.distance) for r in leaks_of.leaks(docs, items, **o).collect()}
    assert found() == {(1, 1, 1), (2, 1, 2), (1, 2, 0), (3, 2, 0), (4, 2, 0)}
    assert found(whole_words=24) == {(3, 2, 0)}


def test_leaks_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(leaks_of, "BLOCK_CHARS", 40)
    bench = spark.createDataFrame([(1, "Alpha  beta gamma delta epsilon"), (2, None), (3, "  "), (4, "this is nowhere to be found in the documents"), (None, "alpha beta gamma delta epsilon")], "item_id long, text string")
    got = leaks_of.leaks(odd(spark, [(9, "x " * 200_000 + "alpha beta gamma delta epsilon", "en", "a", 1)]), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, i) for d in (1, 5, None, 9) for i in (1, None)}
    assert leaks_of.leaks(none(spark), bench).count() == 0
    assert leaks_of.leaks(odd(spark), bench.limit(0)).count() == 0


# 5


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 60), (9, "u", "long " * 400_000), (0, "u", "zero " * 30), (10, "u", "zero " * 30), (2, "http://a/2", big)]
    got = sorted(tuple(r) for r in zip_warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    first, want = {}, []
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        b = (h or "").encode()
        if len(b) >= 100:
            first.setdefault(b, i)
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b, i)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    assert [tuple(map(str, g)) for g in got] == sorted(tuple(map(str, w)) for w in want) or sorted(map(str, got)) == sorted(map(str, want))
    assert zip_warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_payloads_come_back(spark):
    pages = table(spark, "pages")
    root = zip_warc.scratch_path(spark, "t")
    back = zip_warc.read_archives(zip_warc.write_archives(pages, root, archive_bytes=50_000), keep_payload=True).where("record_type = 'response'")
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    got = {r.page_id: bytes(r.payload) for r in back.collect()}
    assert got.items() <= want.items() and set(got.values()) == set(want.values())


@pytest.mark.parametrize("large", [False, True])
def test_directory_of_any_zip(tmp_path, large):
    p = tmp_path / "a.zip"
    with zipfile.ZipFile(p, "w", zipfile.ZIP_STORED) as z:
        with z.open("archive/é.bin", "w", force_zip64=large) as f:
            f.write(b"0123456789")
        z.writestr("deflated", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("last", b"PK\x05\x06 not the end")
        z.comment = b"a comment"
    data = p.read_bytes()
    got = zip_warc.members(lambda at, n: data[at : at + n], len(data))
    assert {k: data[m.start : m.start + m.size] for k, m in got.items()} == {"archive/é.bin": b"0123456789", "last": b"PK\x05\x06 not the end"}
    with pytest.raises(ValueError, match="end of central directory"):
        zip_warc.members(lambda at, n: data[:20][at : at + n], 20)


def test_zip64_end_record():
    import struct

    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 4, 4, 1, 0) + b"a" + b"data"
    extra = struct.pack("<HHQQQ", 1, 24, 4, 4, 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    finder = b"PK\x06\x07" + struct.pack("<IQI", 0, len(local) + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + central + end64 + finder + end
    m = zip_warc.members(lambda at, n: data[at : at + n], len(data))["a"]
    assert data[m.start : m.start + m.size] == b"data"


# 6


def pseudonyms(spark, *texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.text, r.n_pseudonyms) for r in feistel_pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_form_and_links(spark):
    got = pseudonyms(spark, "card 4041894974608795, again 4041-8949-7460-8795.", "ring +1 (988) 555-2485 or 988-555-2485", "at 70.123.182.155 and 300.1.2.3", "on 2021-03-04, 04/03/2021", "ssn 123-45-6789 not 000-12-3456", "a.b1@x.org A.B1@x.org", "4041894974608796 is no card; v1.2.3; 2021-13-45", None, "")
    cards = re.findall(r"[\d-]{16,19}", got[0][0])
    assert cards[0] != "4041894974608795" and cards[1].replace("-", "") == cards[0] and luhn(cards[0])
    a, b = re.search(r"ring \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3}-\d{3}-\d{4})", got[1][0]).group(1, 2, 3), re.search(r"\d{3}-\d{3}-\d{4}", got[1][0])[0]
    assert "-".join(a) == b and a != ("988", "555", "2485")
    assert re.fullmatch(r"at (\d{1,3}\.){3}\d{1,3} and 300\.1\.2\.3", got[2][0]) and "70.123.182.155" not in got[2][0]
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d)", got[3][0]).groups()
    assert f"{d}/{m}/{y}" in got[3][0] and (y, m, d) != ("2021", "03", "04")
    assert "not 000-12-3456" in got[4][0] and "123-45-6789" not in got[4][0]
    one, two = got[5][0].split(" ")
    assert one == two.lower() and one.endswith("@x.org") and one != "a.b1@x.org" and (two == one or two[0].isupper() or two[2].isupper())
    assert got[6] == ("4041894974608796 is no card; v1.2.3; 2021-13-45", 0) and got[7:] == [(None, 0), ("", 0)]
    assert pseudonyms(spark, "70.123.182.155", key="other") != pseudonyms(spark, "70.123.182.155")


def test_pseudonyms_keep_widths(spark):
    days = [f"{d}/{m}/2021" for d in (1, 9, 10, 31) for m in (1, 3, 10, 12)] + ["07/04/2021", "2021-1-5", "2021-01-05"]
    got = [t for t, _ in pseudonyms(spark, *days)]
    for was, now in zip(days, got, strict=True):
        assert was != now
        for a, b in zip(re.split("[/-]", was), re.split("[/-]", now), strict=True):
            assert len(b) == len(a) or len(a) == 1 and int(b) > 9
    assert [int(x) for x in got[-1].split("-")] == [int(x) for x in got[-2].split("-")]


def test_feistel_is_a_permutation(spark):
    for a, b in ((1, 36), (17, 43), (10, 100)):
        pairs = spark.range(a * b).select((F.col("id") / b).cast("long").alias("x"), (F.col("id") % b).alias("y"))
        out = pairs.select(feistel_pii.feistel(F.col("x"), F.col("y"), a, b, "k", "t").alias("f")).select("f.left", "f.right").collect()
        assert len({tuple(r) for r in out}) == a * b and all(0 <= r.left < a and 0 <= r.right < b for r in out)


def test_dates_and_ids_stay_distinct(spark):
    days = [f"19{y:02d}-{m:02d}-{d:02d}" for y in range(0, 99, 7) for m in (1, 6, 12) for d in (1, 15, 28)]
    ids = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in (1, 9999)]
    for values in (days, ids):
        got = [t for t, n in pseudonyms(spark, *values)]
        assert len(set(got)) == len(values) and all(re.fullmatch(re.sub(r"\d", r"\\d", v), g) for v, g in zip(values, got, strict=True))


def test_pseudonyms_keep_rows_and_columns(spark):
    df = odd(spark, [(9, "x" * 300_000 + " 70.123.182.155 " + "y" * 1000, "en", "a", 1)])
    out = feistel_pii.pseudonymise(df, "k")
    assert out.columns == [*df.columns, "n_pseudonyms"] and out.count() == df.count()
    assert feistel_pii.pseudonymise(none(spark), "k").count() == 0


# 7


def test_toxicity_on_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = nblr_toxicity.train(docs.where(~nblr_toxicity.held_out()), labels)
    rows = nblr_toxicity.score(docs.withColumn("held_out", nblr_toxicity.held_out()), model, "doc_id", "held_out").join(labels, "doc_id").where("held_out and toxic is not null").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in good] for a in bad]) > 0.95
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.02
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_rule(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), nblr_toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity_of_odd_rows(spark):
    df = odd(spark, [(20 + i, "you stupid fool" if i % 2 else "a fine day", "en", "a", 1) for i in range(40)])
    labels = spark.createDataFrame([(20 + i, i % 2) for i in range(40)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = nblr_toxicity.train(df, labels)
    rows = nblr_toxicity.score(df, model, "doc_id", "lang").collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id >= 20)
    for bad in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        assert nblr_toxicity.score(df, nblr_toxicity.train(df, bad), "doc_id").count() == df.count()
    assert nblr_toxicity.score(none(spark), model, "doc_id").count() == 0


def test_long_texts_are_read_to_the_end(monkeypatch):
    with np.errstate(over="ignore"):
        text = "ab cd " * 3000 + "the very end"
        whole = set(nblr_toxicity._grams(text, (4, 6)))
        monkeypatch.setattr(nblr_toxicity, "_PIECE", 1000)
        assert set(nblr_toxicity._grams(text, (4, 6))) == whole


# 8


def links(ids, x, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    g = Union()
    for i in ids:
        g.root(i)
    for a, b in zip(*np.nonzero(hit), strict=True):
        g.join(ids[a], ids[b])
    return {i: (int(n), g.root(i), g.root(i) == i) for i, n in zip(ids, hit.sum(axis=1), strict=True)}


@pytest.mark.parametrize("block", [16, 2048])
def test_near_vectors(spark, block):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16))
    x = np.vstack([centres[rnd.integers(12, size=300)] + rnd.normal(scale=0.25, size=(300, 16)), centres[:1].repeat(20, axis=0), 3 * centres[:2]])
    ids = [int(i) for i in rnd.permutation(len(x)) + 5]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, block=block).collect()}
    want = links(ids, x, 0.95)
    assert got == want and len({c for _, c, _ in want.values()}) > 3


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [1e200, 1e190])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit("clash")).withColumn("h", F.lit(1))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in ego_join.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 3, 1), (2, 3, 1), (10, 3, 1), (11, 3, 1), *((i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9)), (None, 0, None)], key=str)
    assert ego_join.near_vectors(df.limit(0)).count() == 0


# 9


def test_shards_keep_every_row(spark):
    df = odd(spark, [(9, "x" * 500_000, "en", "a", 1)])
    store, rows = tier_compaction.shard_documents(df, arrivals=3, target_bytes=20_000, fanout=2)
    key = lambda d: Counter(map(str, d.collect()))
    assert key(rows) == key(df) and len(store.versions()) == 1
    assert tier_compaction.shard_map(none(spark), arrivals=2).count() == 0


@pytest.mark.parametrize("target", [20_000, 100_000, 64_000_000])
def test_shard_map_names_the_shard_that_holds_the_row(spark, target):
    """Also shards above the target, which no merge ever renames: each row once, with the place of the shard that holds it."""
    docs = table(spark, "documents").repartition(3)
    docs = docs.unionByName(docs.limit(1))
    placed = tier_compaction.shard_map(docs, arrivals=4, target_bytes=target).collect()
    assert Counter(r.doc_id for r in placed) == Counter(r.doc_id for r in docs.collect())
    assert all(r.shard is not None and r.shard_bytes > 0 for r in placed)
    store, rows = tier_compaction.shard_documents(docs, arrivals=4, target_bytes=target)
    held = {(tuple(sorted(r.doc_id for r in spark.read.parquet(s.path).collect())), s.bytes) for s in store.shards()}
    shards = defaultdict(list)
    for r in placed:
        shards[r.shard, r.shard_bytes].append(r.doc_id)
    assert sorted(tuple(sorted(v)) for v in shards.values()) == sorted(ids for ids, _ in held)


def test_compaction_reaches_the_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    store = tier_compaction.ShardStore(spark, tier_compaction.scratch_path(spark, "t"), target_bytes=400_000, fanout=4)
    for k in range(12):
        store.append(docs.where(F.col("doc_id") % 12 == k).coalesce(2))
    before = store.shards()
    version = store.compact(final=True)
    after = store.shards()
    assert len(after) < len(before) / 2 and max(s.bytes for s in after) < 800_000 and store.read().count() == docs.count()
    assert len(store.shards(12)) == 12 and store.read().count() == docs.count()  # an older version is still whole
    store.vacuum()
    assert store.versions() == [version] and store.read().count() == docs.count()


def test_of_two_commits_one_fails(spark):
    store = tier_compaction.ShardStore(spark, tier_compaction.scratch_path(spark, "t"))
    store.commit(1, [])
    with pytest.raises(tier_compaction.CommitConflict):
        store.commit(1, [tier_compaction.Shard("x", 1, 0)])
    assert store.shards() == [] and store.versions() == [1]


def test_appends_during_a_merge_stay(spark, monkeypatch):
    """Another writer commits between the merge and its commit; a merge whose shards another has merged is dropped."""
    root = tier_compaction.scratch_path(spark, "t")
    store, other = (tier_compaction.ShardStore(spark, root, target_bytes=10_000_000, fanout=2) for _ in range(2))
    for k in range(3):
        store.append(spark.range(10 * k, 10 * k + 10).coalesce(1))
    plain, calls = store.shards, []

    def late(version=None):
        out = plain(version)
        if version is not None and len(calls) < 2:
            calls.append(other.append(spark.range(100 + 10 * len(calls), 110 + 10 * len(calls)).coalesce(1)))
        return out

    monkeypatch.setattr(store, "shards", late)
    store.compact(final=True)
    assert len(calls) == 2 and store.read().count() == 50 == store.read().distinct().count()
    assert other.compact(final=True) >= 5 and other.vacuum() > 0 and other.read().count() == 50


def test_concurrent_merges_lose_nothing(spark, monkeypatch):
    root = tier_compaction.scratch_path(spark, "t")
    store, other = (tier_compaction.ShardStore(spark, root, target_bytes=10_000_000, fanout=2) for _ in range(2))
    for k in range(4):
        store.append(spark.range(10 * k, 10 * k + 10).coalesce(1))
    write, done = store._write_apart, []
    monkeypatch.setattr(store, "_write_apart", lambda *a: (write(*a), done or done.append(other.compact(final=True))))
    store.compact(final=True)
    assert done and store.read().count() == 40 == store.read().distinct().count()


def test_long_manifests_come_back(spark):
    store = tier_compaction.ShardStore(spark, tier_compaction.scratch_path(spark, "t"))
    for k in range(20):
        store.add([tier_compaction.Shard(f"p{k}", k, 0)])
    store.change(lambda now: ([], ["p3", "p17"]))
    assert [s.path for s in store.shards()] == [f"p{k}" for k in range(20) if k not in (3, 17)]
    assert len(store.shards(5)) == 5 and len(store.shards(16)) == 16


# 10


def test_token_counts_with_any_chunks(spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=resync_tokens.model_path("piece_bpe_32k.model"))
    extra = ["x" * 3000, "日本語" * 700 + " 🎉🎉 " + "é" * 500, " " * 400 + "a" + "  " * 300, "▁a▁▁b " * 200, "<s> </s> <0x0A> \n\t" * 90, "ab\n" * 900, ""]
    df = odd(spark, [(100 + i, t, "en", "a", 1) for i, t in enumerate(extra)]).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(p.encode(r.text or ""))) for r in df.collect())
    for options in ({}, {"huge": 300, "chunk": 150, "overlap": 8}, {"huge": 1000, "chunk": 400, "overlap": 64}):
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in resync_tokens.token_counts(df, **options).collect()) == want
    assert resync_tokens.token_counts(none(spark)).count() == 0


def test_boundaries_are_proven(spark):
    assert resync_tokens.splittable(resync_tokens.model_path("piece_bpe_32k.model"))
