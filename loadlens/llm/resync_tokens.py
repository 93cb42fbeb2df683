"""Token counts by overlap resynchronisation.

Ordinary texts are encoded whole. A huge text is cut into overlapping chunks that are encoded apart, with offsets. Where
the token sequences of two neighbours share a boundary that is proven stable, they are spliced: the tokens before it
count from the left chunk, those after it from the right one. A boundary is stable if no merge can reach across it. For
a sentencepiece BPE model that is so between a character that is no blank and a blank, if no piece of the vocabulary
holds such a pair and the normaliser changes nothing; both are read from the model. Where an overlap has no stable
boundary, the text is cut again with a wider overlap, at last into one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import materialize

#: Texts encoded in one call; bounds the memory for token ids.
_AT_ONCE = 128
_BLANK = " ▁"


@lru_cache(maxsize=4)
def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def model_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; every worker has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def splittable(model: str) -> bool:
    """Whether boundaries before blanks are stable: no piece holds a non-blank followed by a blank, and text is kept as it is."""
    p = _processor(model)
    pieces = (p.id_to_piece(i) for i in range(p.get_piece_size()))
    kept = p.encode("a  b ", out_type=str)
    return not any(re.search(f"[^{_BLANK}][{_BLANK}]", x) for x in pieces) and "".join(kept).replace("▁", " ") == " a  b "


def token_ends(model: str, text: str) -> list[int]:
    """For each token, the code points of text that it and those before it have fully covered."""
    ends, at, left = [], -1, 0  # the blank put before the text covers nothing
    for piece in _processor(model).encode(text, out_type=str):
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        if byte and not (at >= 0 and text.startswith(piece, at)) or byte and left:
            if not left:  # first byte of a character
                b = int(byte[1], 16)
                left = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            left -= 1
            at += not left
        else:
            at += len(piece)
        ends.append(at)
    return ends


def stable_boundaries(text: str, lo: int, hi: int) -> list[int]:
    """Offsets from lo to below hi where a non-blank is followed by a blank."""
    return [i for i in range(max(lo, 1), min(hi, len(text))) if text[i] in _BLANK and text[i - 1] not in _BLANK]


def _count_whole(model_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _processor(model_path(model_name)).encode
        for batch in batches:
            n = []
            for i in range(0, batch.num_rows, _AT_ONCE):
                n += map(len, encode([x or "" for x in batch.column(2).slice(i, _AT_ONCE).to_pylist()], num_threads=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk: int, overlap: int):
    """(h, part, parts, start, text) for each chunk of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py()
                parts = max(1, -(-len(t) // chunk)) if overlap < len(t) else 1
                for k in range(parts):
                    piece = t[k * chunk : (k + 1) * chunk + overlap] if parts > 1 else t
                    yield pa.RecordBatch.from_pydict({"h": [h], "part": pa.array([k], pa.int64()), "parts": pa.array([parts], pa.int64()), "start": pa.array([k * chunk], pa.int64()), "text": [piece]})

    return run


def _encode_chunks(model_name: str, chunk: int, overlap: int):
    """Per chunk: the number of its tokens, and the stable boundaries in its two overlaps with the tokens before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_path(model_name)
        mark = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            for row in batch.to_pylist():
                text, start = row["text"], row["start"]
                ends = token_ends(model, text)
                before = {e: i + 1 for i, e in enumerate(ends)}  # the last token that ends there
                marks = lambda lo, hi: [{"at": start + b, "n": before[b]} for b in stable_boundaries(text, lo, hi) if b in before]  # noqa: B023, E731
                head = marks(0, overlap) if row["part"] else []
                tail = marks(chunk, chunk + overlap) if row["part"] + 1 < row["parts"] else []
                yield pa.RecordBatch.from_arrays([pa.array([row["h"]]), pa.array([row["part"]], pa.int64()), pa.array([row["parts"]], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([head], mark), pa.array([tail], mark)], names=["h", "part", "parts", "n", "head", "tail"])

    return run


def _spliced(texts: DataFrame, model_name: str, chunk: int, overlap: int) -> DataFrame:
    """(h, n_tokens) of the texts (h, text); null where some pair of neighbours has no common stable boundary."""
    cut = texts.mapInArrow(_cut(chunk, overlap), "h string, part long, parts long, start long, text string")
    mark = "array<struct<at: long, n: long>>"
    coded = cut.repartition("h", "part").mapInArrow(_encode_chunks(model_name, chunk, overlap), f"h string, part long, parts long, n long, head {mark}, tail {mark}")
    coded = materialize(coded, "chunks")
    left, right = coded.where("part + 1 < parts").alias("l"), coded.where("part > 0").alias("r")
    common = F.array_min(F.array_intersect(F.col("l.tail.at"), F.col("r.head.at")))
    count = lambda marks: F.get(F.filter(marks, lambda m: m["at"] == F.col("at")), F.lit(0))["n"]
    seams = left.join(right, (F.col("l.h") == F.col("r.h")) & (F.col("l.part") + 1 == F.col("r.part"))).select(F.col("l.h").alias("h"), common.alias("at"), F.col("l.n").alias("n"), F.col("l.tail").alias("tail"), F.col("r.head").alias("head"))
    # at each seam the left chunk's tokens after it and the right chunk's tokens before it are surplus
    surplus = seams.select("h", (F.col("n") - count(F.col("tail")) + count(F.col("head"))).alias("surplus"))
    surplus = surplus.groupBy("h").agg(F.sum("surplus").alias("surplus"), F.count("surplus").alias("good"))
    total = coded.groupBy("h").agg(F.sum("n").alias("n"), F.max("parts").alias("parts"))
    whole = F.coalesce("good", F.lit(0)) == F.col("parts") - 1
    return total.join(surplus, "h", "left").select("h", F.when(whole, F.col("n") - F.coalesce("surplus", F.lit(0))).alias("n_tokens"))


def token_counts(docs: DataFrame, model_name: str = "piece_bpe_32k.model", huge: int = 65_536, chunk: int = 32_768, overlap: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs (doc_id, text).

    n_bytes is the length in UTF-8, n_tokens what the library gives for the whole text, without begin, end or added
    special tokens. A null text counts as empty: 0 and 0. Texts of more than huge code points are counted by chunks, equal
    ones once. Rows are never merged: equal rows and null doc_ids give a row each. Other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_huge = F.length("text") > huge if splittable(model_path(model_name)) else F.lit(False)
    sized = base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    ordinary = sized.where(~is_huge).mapInArrow(_count_whole(model_name), sized.select("doc_id", "n_bytes").schema.add("n_tokens", "long"))
    large = sized.where(is_huge).select("doc_id", "n_bytes", F.sha2("text", 256).alias("h"), "text")
    todo = materialize(large.select("h", "text").dropDuplicates(["h"]), "huge")
    counted, done = None, None
    while counted is None or not todo.isEmpty():
        done = materialize(_spliced(todo, model_name, chunk, overlap), "spliced")
        good = done.where("n_tokens is not null")
        counted = good if counted is None else counted.unionByName(good)
        todo = todo.join(done.where("n_tokens is null"), "h", "left_semi")
        overlap *= 8
        chunk = max(chunk, overlap)
    return ordinary.unionByName(large.drop("text").join(counted, "h").select("doc_id", "n_bytes", "n_tokens"))
