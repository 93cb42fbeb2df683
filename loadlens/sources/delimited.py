"""Delimited text of any size: one large file with quoted line ends is read by many tasks.

Spark's text reader cuts files by bytes, at line feeds. Its lines are written once, with their quotes counted. Most files
have no row that goes on over lines, which the quotes of their lines tell: there, a line is a row, numbered by the lines of
the chunks before it, and split where it is by built-in functions; rows with quotes inside of cells go through Python.

In other files, whether a line feed ends a row depends on how many quotes stand before it in the whole file, so each chunk is
first read on its own: lines are numbered, and marked by the parity of the quotes before them in the chunk. A small table
with the parity of each chunk gives, by a running XOR over the chunks of a file, the state in which a chunk begins, and by a
running last the line that opened a row which it continues. Only the lines of rows that go on over several lines meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.sources.files import saved

SEPARATORS = (",", "\t", ";")
#: Bytes of a file that are looked at for its separator and its byte order, and the lines that mostly are enough for that.
_HEAD, _NEAR = 65_536, 64
#: Rows, and files in UTF-16, which are decoded whole, are reported and not read from this size.
MOST_ROW, MOST_WHOLE = 64_000_000, 100_000_000


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple], bytes]]:
    """Per batch and chunk (path, block): tuples (line, rel, odd, last0, last1, value). rel is the parity of quotes before the line;
    last0 and last1 are the last lines up to this one with a rel of 0 and of 1, or -1."""
    at, line, rel, last = None, 0, 0, [-1, -1]
    for batch in batches:
        paths, blocks, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for path, block, value in zip(paths, blocks, batch.column(2), strict=True):
            if (path, block) != at:
                if out:
                    yield at, out
                    out = []
                at, line, rel, last = (path, block), 0, 0, [-1, -1]
            raw = value.as_buffer().to_pybytes()
            last[rel] = line
            odd = raw.count(b'"') & 1
            out.append((line, rel, odd, last[0], last[1], raw))
            line, rel = line + 1, rel ^ odd
        if out:
            yield at, out


def form_of(head: bytes) -> tuple[str, str]:
    """The encoding by the mark of the byte order, and the separator that is most frequent outside quotes in the first eight
    lines that are not empty, earlier ones first on ties."""
    encoding = {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}.get(head[:2], "UTF-8")
    text = head[: len(head) // 2 * 2] if encoding != "UTF-8" else head
    lines = [line for line in text.decode(encoding, "replace").removeprefix("\ufeff").replace("\r\n", "\n").split("\n") if line][:8]
    bare = "\n".join("".join(line.split('"')[::2]) for line in lines)
    return encoding, max(SEPARATORS, key=bare.count)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: its lines, the parity of its quotes and the last lines with a rel of 0 and of 1."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("parity", pa.int32()), ("last0", pa.int64()), ("last1", pa.int64())])
    at, row = None, ()

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*at, *row), schema, strict=True)], schema=schema)

    for key, lines in _numbered(batches):
        if at not in (None, key):
            yield emit()
        line, rel, odd, last0, last1, _ = lines[-1]
        at, row = key, (line + 1, rel ^ odd, last0, last1)
    if at is not None:
        yield emit()


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, encoding, separator) of files, from their first lines (path, value) in order."""
    schema = pa.schema([("path", pa.string()), ("encoding", pa.string()), ("separator", pa.string())])
    at, head = None, b""
    emit = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, *form_of(head))], schema=schema)
    for batch in batches:
        for path, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != at:
                if at is not None:
                    yield emit()
                at, head = path, b""
            if len(head) < _HEAD:
                head += value + b"\n"
    if at is not None:
        yield emit()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (path, block), lines in _numbered(batches):
        line, rel, odd, last0, last1, raw = zip(*lines, strict=True)
        n = len(line)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path] * n), pa.array([block] * n, pa.int64()), pa.array(line, pa.int64()), pa.array(rel, pa.int32()), pa.array(odd, pa.int32()), pa.array(last0, pa.int64()), pa.array(last1, pa.int64()), pa.array(raw, pa.binary())],
            names=["path", "block", "line", "rel", "odd", "last0", "last1", "value"],
        )


def rows_of(text: str, separator: str) -> list[list[str]]:
    """The rows of a piece of text that begins outside quotes: quotes may open anywhere in a cell, doubled ones inside quotes are
    one, line feeds, carriage returns or both end a row outside of them."""
    if '"' not in text and "\r" not in text and "\n" not in text:
        return [text.split(separator)]
    rows, row, cell = [], [], []
    parts = text.split('"')
    for i, part in enumerate(parts):
        if i % 2:
            cell.append(part)
        elif not part and 0 < i < len(parts) - 1:
            cell.append('"')  # the second of two quotes in a row
        else:
            lines = part.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for j, line in enumerate(lines):
                if j:
                    rows.append([*row, "".join(cell)])
                    row, cell = [], []
                first, *more = line.split(separator)
                cell.append(first)
                for piece in more:
                    row.append("".join(cell))
                    cell = [piece]
    rows.append([*row, "".join(cell)])
    return rows


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, encoding, separator, line, part, cells) of pieces of text (path, encoding, separator, line, its lines), without blank rows."""
    schema = pa.schema([("path", pa.string()), ("encoding", pa.string()), ("separator", pa.string()), ("line", pa.int64()), ("part", pa.int32()), ("cells", pa.list_(pa.string()))])
    for batch in batches:
        out = []
        for path, encoding, separator, line, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            value = b"\n".join(lines)
            if encoding != "UTF-8" and len(value) % 2:
                value += b"\n"  # half of the last line end, of which the reader has left the other half
            if encoding == "UTF-8" and line == 0:
                value = value.removeprefix(b"\xef\xbb\xbf")
            text = value.decode(encoding, "replace")
            if encoding != "UTF-8":
                text = text.removeprefix("\ufeff")
            found = rows_of(text, separator)
            out += [(path, encoding, separator, line, k, cells) for k, cells in enumerate(found) if any(cells)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _taken(c: Column, text: str) -> Column:
    """How often a character of one byte is in a text."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(text), F.lit("")))


def _chunked(lines: DataFrame) -> DataFrame:
    """(path, block, start, base, encoding, separator, size, quiet) of the chunks of lines (path, block, at, value, quotes): at of
    the chunk's first line, the lines of its file before it, the form and bytes of the file, and whether each line of it is
    a row: none has an odd number of quotes, and none is in UTF-16."""
    chunks = saved(lines.groupBy("path", "block").agg(F.min("at").alias("start"), F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("size"), F.sum(F.col("quotes") % 2).alias("odd")), "chunks")
    first = lines.join(chunks.where("block = 0").select("path", "block", "start", F.col("lines").alias("n")), ["path", "block"]).withColumn("nth", F.col("at") - F.col("start"))
    # eight lines that are not blank, or all of the head
    short = first.where(F.col("nth") < _NEAR).groupBy("path").agg(F.count_if(~F.col("value").cast("string").isin("", "\r")).alias("full"), F.max("n").alias("n"))
    look = saved(short.select("path", F.when((F.col("full") >= 8) | (F.col("n") <= _NEAR), _NEAR).otherwise(_HEAD).alias("look")), "looks")
    heads = first.join(look, "path").where(F.col("nth") < F.col("look")).select("path", "at", F.substring("value", 1, _HEAD).alias("value"))
    forms = heads.repartition("path").sortWithinPartitions("path", "at").select("path", "value").mapInArrow(_forms, "path string, encoding string, separator string")
    whole = chunks.groupBy("path").agg(F.sum("size").alias("size"), (F.sum("odd") == 0).alias("even"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.select("path", "block", "start", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"))
    forms = saved(forms.join(whole, "path").select("path", "encoding", "separator", "size", (F.col("even") & (F.col("encoding") == "UTF-8")).alias("quiet")), "forms")
    return saved(placed.join(forms, "path"), "placed")


def _split(lines: DataFrame) -> DataFrame:
    """(path, encoding, separator, line, cells, rest) of lines that are rows: cells where cells have either no quotes at all or each of
    them one at its begin and its end, and the line itself as rest where that is not so. A blank line has neither."""
    mark = "\x01"
    given = F.col("value").cast("string")
    text = F.replace(given, F.lit("\r"), F.lit(""))
    parted = lambda c, by: F.replace(c, by, F.lit(mark))
    quoted = F.col("quotes") > 0
    out = lines.withColumn("body", F.when(quoted, parted(F.substring(text, F.lit(2), F.length(text) - 2), F.concat(F.lit('"'), "separator", F.lit('"')))).otherwise(parted(text, F.col("separator"))))
    returns = _taken(given, "\r")
    fine = (returns == 0) | ((returns == 1) & given.endswith("\r"))
    fine &= ~quoted | (text.startswith('"') & text.endswith('"') & (F.col("quotes") == 2 * (_taken(F.col("body"), mark) + 1)))
    fine &= ~given.contains(mark) & F.is_valid_utf8(given) & ((F.col("line") > 0) | ~given.startswith("\ufeff"))
    some = F.replace("body", F.lit(mark), F.lit("")) != ""
    out = out.withColumns({"fine": fine, "some": some})
    return out.select("path", "encoding", "separator", "line", F.when(F.col("fine") & F.col("some"), F.split("body", mark, -1)).alias("cells"), F.when(~F.col("fine"), F.col("value")).alias("rest"))


def chunk_states(chunks: DataFrame) -> DataFrame:
    """(path, block, state, base, carried): whether a chunk begins inside quotes, the lines before it, and the number of the
    line that opened the row in which it begins."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = F.pmod(F.coalesce(F.sum("parity").over(before), F.lit(0)), F.lit(2)).cast("int")
    placed = chunks.select("path", "block", "last0", "last1", state.alias("state"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"))
    opened = F.when(F.col("state") == 0, F.col("last0")).otherwise(F.col("last1"))
    opened = F.when(opened >= 0, F.col("base") + opened)
    return placed.select("path", "block", "state", "base", F.last(opened, ignorenulls=True).over(before).alias("carried"))


def _loud(lines: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of read_delimited for files in which a line may be a part of a row."""
    # a chunk's lines in order, in one task
    raw = lines.join(placed.where("not quiet").select("path", "block"), ["path", "block"], "left_semi").repartition("path", "block").sortWithinPartitions("path", "block", "at").select("path", "block", "value")
    chunks = saved(raw.mapInArrow(_chunks, "path string, block long, lines long, parity int, last0 long, last1 long"), "loud")
    numbered = raw.mapInArrow(_lines, "path string, block long, line long, rel int, odd int, last0 long, last1 long, value binary")
    forms = placed.where("block = 0").select("path", "encoding", "separator", "size")
    lines = numbered.join(chunk_states(chunks), ["path", "block"]).join(forms, "path")
    inside = F.col("rel") != F.col("state")
    opened = F.when(F.col("state") == 0, F.col("last0")).otherwise(F.col("last1"))
    lines = lines.select("path", "encoding", "separator", "size", (F.col("base") + F.col("line")).alias("line"), F.when(opened >= 0, F.col("base") + opened).otherwise(F.col("carried")).alias("opened"), (~inside & (F.col("odd") == 0)).alias("single"), "value")
    lines = saved(lines, "numbered")
    wide = F.col("encoding") != "UTF-8"
    single = lines.where(~wide & F.col("single")).select("path", "encoding", "separator", "line", F.array("value").alias("values"))
    # rows of several lines, and files in UTF-16 as rows of their own
    several = lines.where(wide | ~F.col("single")).withColumn("opened", F.when(wide, F.lit(0)).otherwise(F.col("opened"))).where(~wide | (F.col("size") <= MOST_WHOLE))
    sizes = several.groupBy("path", "opened").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max(wide).alias("wide"))
    large = sizes.where(~F.col("wide") & (F.col("bytes") > MOST_ROW))
    several = several.join(large.select("path", "opened"), ["path", "opened"], "left_anti")
    values = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"])  # bounded by MOST_ROW and MOST_WHOLE bytes
    several = several.groupBy("path", "encoding", "separator", F.col("opened").alias("line_")).agg(values.alias("values")).withColumnRenamed("line_", "line")
    problems = large.select("path", F.concat(F.lit("a row of "), "bytes", F.lit(" bytes begins at line "), F.col("opened") + 1).alias("problem"))
    problems = problems.unionByName(forms.where(wide & (F.col("size") > MOST_WHOLE)).select("path", F.concat(F.lit("a file of "), "size", F.lit(" bytes in "), "encoding").alias("problem")))
    return single.unionByName(several).mapInArrow(_parsed, _ROWS), problems


_ROWS = "path string, encoding string, separator string, line long, part int, cells array<string>"


def read_delimited(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, encoding, separator, line, part, cells) for each row of the files below path that is not blank, and (path, problem) for
    what is too large to be read. line is the row's first line in its file; part tells rows apart that lone carriage
    returns divide. Each file has its own separator and encoding; an unclosed quote takes the rest of the file, but
    for its last line end, as its cell.

    No table by path comes to the driver, and nothing but files in UTF-16, of bounded size, is read whole by one task."""
    lines = saved(_raw(spark, path).select("path", "block", F.monotonically_increasing_id().alias("at"), "value", _taken(F.col("value").cast("string"), '"').alias("quotes")), "lines")
    placed = _chunked(lines)
    calm = saved(_split(lines.join(placed.where("quiet"), ["path", "block"]).withColumn("line", F.col("base") + F.col("at") - F.col("start"))), "calm")
    rows = calm.where("cells is not null").select("path", "encoding", "separator", "line", F.lit(0).alias("part"), "cells")
    rest = calm.where("rest is not null").select("path", "encoding", "separator", "line", F.array("rest").alias("values"))
    if not rest.isEmpty():
        rows = rows.unionByName(rest.mapInArrow(_parsed, _ROWS))
    problems = spark.createDataFrame([], "path string, problem string")
    if not placed.where("not quiet").isEmpty():
        more, problems = _loud(lines, placed)
        rows = rows.unionByName(more)
    return rows, problems


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, line, cells): the rows of captures below path, headers included; files that cannot be read have none."""
    rows, _ = read_delimited(spark, path)
    return rows.select("path", "encoding", (F.col("line") + F.col("part") / 1_000_000_000).alias("line"), "cells")
