"""Scalar functions on captured cells: parsing, classifying and formatting, each a Column made of built-in functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Powers of 1000 of a number's unit, with and without B and i.
_POWERS = {letter + tail: i for i, letter in enumerate(("", "K", "M", "G", "T", "P", "E")) for tail in ("", "B", "IB")}
# The classes of waits in order, each with its prefixes and its whole types.
WAIT_CLASSES = (
    ("Benign / queue", ("WAITFOR", "LAZYWRITER_SLEEP", "SLEEP_TASK", "BROKER_", "XE_TIMER_EVENT", "ONDEMAND_TASK_QUEUE"), ()),
    ("Locking", ("LCK_",), ()),
    ("Storage I/O", ("PAGEIOLATCH_",), ("IO_COMPLETION", "ASYNC_IO_COMPLETION")),
    ("Transaction log", (), ("WRITELOG",)),
    ("Compilation", (), ("RESOURCE_SEMAPHORE_QUERY_COMPILE",)),
    ("Memory grant", ("RESOURCE_SEMAPHORE",), ()),
    ("Worker threads", (), ("THREADPOOL",)),
    ("Network / client", (), ("ASYNC_NETWORK_IO",)),
    ("Latch / tempdb", ("PAGELATCH_", "LATCH_"), ()),
    ("Parallelism", (), ("CXPACKET", "CXCONSUMER", "CXSYNC_PORT", "CXSYNC_CONSUMER")),
    ("External", ("PREEMPTIVE_",), ("OLEDB", "CLR_AUTO_EVENT")),
)
#: Words that say that there is no wait, and words that are no type of one.
NO_WAIT, NO_TYPE = ("NONE", "N/A"), ("ON", "OFF", "TRUE", "FALSE", "NULL", "NONE")
#: Words for a missing spill metric.
NOT_GIVEN = ("null", "n/a", "none", "not supplied")


def as_text(value: Column) -> Column:
    """Trimmed text; null for an empty text and for NULL in any case."""
    t = F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
    return F.when((t != "") & (F.upper(t) != "NULL"), t)


def _match(text: Column, pattern: str, group: int) -> Column:
    """The group of the first match; null if there is no match or the group took no part."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def plain_number(text: Column) -> Column:
    """A text that is digits, with a sign, a fraction or an exponent, as a number; else null."""
    digit = lambda c: c.between("0", "9")
    plain = digit(F.left(text, F.lit(1))) & digit(F.right(text, F.lit(1)))  # most are, and need no pattern
    return F.when(plain, text.try_cast("double")).when(text.rlike("^[-+]?[0-9]") & text.rlike("[0-9]$"), text.try_cast("double"))


def as_number(value: Column) -> Column:
    """A number with an optional unit (a power of 1000), else the first number in the text."""

    def parts(t: Column) -> Column:
        unit = F.regexp_extract(t, "[A-Za-z]*$", 0)
        body = F.rtrim(F.substring(t, F.lit(1), F.length(t) - F.length(unit)))
        return F.struct(t.alias("t"), plain_number(body).alias("n"), _lookup(_POWERS, F.upper(unit)).alias("power"))

    first = lambda t: F.regexp_extract(t, r"-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?", 0).try_cast("double")
    scaled = lambda p: F.coalesce(p["n"] * F.pow(F.lit(1000.0), p["power"]), first(p["t"]))
    return _once(F.replace(as_text(value), F.lit(","), F.lit("")), lambda t: _once(parts(t), scaled))


def excel_timestamp(serial: Column) -> Column:
    """A spreadsheet's day number from 1 to 100000 as a timestamp, to the millisecond."""
    return F.when(serial.between(1, 100000), F.timestamp_millis(F.round((serial - 25569) * 86400000).cast("long")))


def as_timestamp(value: Column) -> Column:
    """ISO text, with a blank or a T between date and time, in UTC; else null."""
    t = as_text(value)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}) ", "$1T")))


def duration_seconds(value: Column) -> Column:
    """Seconds of a text that begins with [days ]hh:mm:ss[.mmm]; what follows does not matter."""

    def clock(words: Column) -> Column:
        dated = words[0].rlike("^[0-9]+$")
        days = F.when(dated, words[0].try_cast("double")).otherwise(0.0)
        return F.struct(days.alias("days"), F.split(F.when(dated, F.get(words, F.lit(1))).otherwise(words[0]), ":").alias("p"))

    def seconds(c: Column) -> Column:
        hours, minutes, rest = (F.get(c["p"], F.lit(i)) for i in range(3))
        fits = hours.rlike("^[0-9]{1,2}$") & minutes.rlike("^[0-9]{2}$") & rest.rlike("^[0-9]{2}")
        fraction = F.coalesce(F.concat(F.lit("0."), _match(rest, "^..[.]([0-9]{1,3})", 1)).try_cast("double"), F.lit(0.0))
        return F.when(fits, c["days"] * 86400 + hours.try_cast("double") * 3600 + minutes.try_cast("double") * 60 + F.substring(rest, 1, 2).try_cast("double") + fraction)

    return _once(F.split(as_text(value), r"\s+"), lambda words: _once(clock(words), seconds))


def difference_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end; null if either is null or the difference is negative."""
    d = (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000
    return F.when(d >= 0, d)


def wait_category(kind: Column) -> Column:
    """The class of a wait type; the first that fits."""
    u, out = F.upper(kind), F.lit("Other")
    for name, prefixes, types in reversed(WAIT_CLASSES):
        fits = [u.startswith(x) for x in prefixes] + ([u.isin(*types)] if types else [])
        out = F.when(_any(*fits), name).otherwise(out)
    return F.when(u.isNotNull(), out)


def _any(first: Column, *rest: Column) -> Column:
    for c in rest:
        first = first | c
    return first


def _once(value: Column, then) -> Column:
    """then(value), with value computed once and kept out of generated code."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _whole(text: Column) -> Column:
    """A whole number, plain or with a comma before each three digits; else null."""
    groups = F.split(text, ",")
    threes = F.forall(F.slice(groups, 2, 2**31 - 1), lambda g: g.rlike("^[0-9]{3}$")) & groups[0].rlike("^[0-9]{1,3}$")
    return F.when(text.rlike("^[0-9]+$") | (text.contains(",") & threes), F.replace(text, F.lit(","), F.lit("")).try_cast("long"))


def _said_no(text: Column) -> Column:
    return F.upper(text).isin(*NO_WAIT)


def parse_wait(value: Column) -> Column:
    """struct<duration_ms, durations, task_count, type, detail, category> of a wait text; null if it is none.

    Two forms: (tasks x: duration/duration/duration)TYPE:detail, with up to three durations in ms and the tasks left out
    for one; and TYPE detail, which may say waittime=duration. A wait without a duration is one all the same."""
    ms = lambda x: _whole(F.rtrim(F.when(F.lower(x).endswith("ms"), F.substring(x, F.lit(1), F.length(x) - 2))))

    def cut(t: Column) -> Column:
        close = F.locate(")", t)
        inside = F.split(F.when(t.startswith("(") & (close > 0), F.substring(t, F.lit(2), close - 2)), ":")
        return F.struct(t.alias("t"), inside.alias("inside"), F.ltrim(F.when(t.startswith("("), F.substring(t, close + 1, F.length(t))).otherwise(t)).alias("rest"))

    def read(c: Column) -> Column:
        inside, rest = c["inside"], c["rest"]
        head = F.when(F.size(inside) == 2, F.trim(inside[0]))
        tasks = F.when(F.lower(head).endswith("x"), _whole(F.substring(head, F.lit(1), F.length(head) - 1)))
        kind = F.regexp_extract(rest, r"^[^:\s]+", 0)
        tail = F.ltrim(F.substring(rest, F.length(kind) + 1, F.length(rest)))
        words = F.split(F.regexp_replace(rest, r"\s*=\s*", "="), r"\s+")
        named = F.filter(words, lambda w: F.lower(w).startswith("waittime="))
        return F.struct(c["t"].startswith("(").alias("native"), F.size(inside).alias("n"), head.alias("head"), tasks.alias("tasks"), kind.alias("kind"), tail.alias("tail"),
                        F.transform(F.split(F.element_at(inside, -1), "/"), lambda x: ms(F.trim(x))).alias("times"), F.transform(F.slice(named, 1, 1), lambda w: _whole(F.substring(w, 10, 99))).alias("named"))

    def wait(p: Column) -> Column:
        whole = (p["n"] <= 2) & (p["head"].isNull() | (p["tasks"] >= 1)) & (F.size(p["times"]) <= 3) & F.forall(p["times"], lambda x: x.isNotNull()) & ((p["tail"] == "") | p["tail"].startswith(":"))
        fits = F.when(p["native"], whole).otherwise(p["kind"].rlike("^[A-Za-z][A-Za-z0-9_]*$"))
        durations = F.when(p["native"], p["times"]).otherwise(F.filter(p["named"], lambda x: x.isNotNull()))
        detail = F.when(p["native"], F.trim(F.substring(p["tail"], F.lit(2), F.length(p["tail"])))).otherwise(F.rtrim(p["tail"]))
        tasks = F.when(p["native"], F.coalesce(p["tasks"], F.lit(1).cast("long")))
        out = F.struct(F.array_max(durations).alias("duration_ms"), durations.alias("durations"), tasks.alias("task_count"), p["kind"].alias("type"), F.nullif(detail, F.lit("")).alias("detail"), wait_category(p["kind"]).alias("category"))
        return F.when(F.coalesce(fits, F.lit(False)) & (p["kind"] != "") & ~F.upper(p["kind"]).isin(*NO_TYPE), out)

    return _once(as_text(value), lambda t: _once(cut(t), lambda c: F.when(~_said_no(c["t"]), _once(read(c), wait))))


def wait_parse_warning(value: Column) -> Column:
    """Whether a wait text is there but says nothing that can be parsed."""
    t = as_text(value)
    return F.coalesce(t.isNotNull() & ~_said_no(t) & parse_wait(value).isNull(), F.lit(False))


def statement_shape(value: Column) -> Column:
    """A statement with its literals as ?, single blanks and lower case."""
    t = F.regexp_replace(F.coalesce(value, F.lit("")), r"N?'(?:''|[^'])*'", "?")
    t = F.regexp_replace(t, r"\b\d+(?:\.\d+)?\b", "?")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def statement_variant(value: Column) -> Column:
    """A statement with single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def command_preview(value: Column, longest: int = 240) -> Column:
    """At most longest characters on one line, an ellipsis for what is cut off; null if blank."""
    t = F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))
    return F.when(F.length(t) <= longest, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, longest - 1)), F.lit("…")))


def command_label(status: Column, text: Column, command: Column) -> Column:
    """What a blocker's command is: a sleeping session's last one, else the current statement or the outer command."""
    sleeping = F.coalesce(F.lower(status) == "sleeping", F.lit(False))
    return F.when(text.isNull() & command.isNull(), None).when(sleeping, "Last / outer command").when(text.isNotNull(), "Current statement").otherwise("Outer command")


def _fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x.cast("double"))


def format_duration(seconds: Column) -> Column:
    """Seconds, minutes, hours or days with the next smaller unit."""
    r = F.floor(seconds + 0.5).cast("long")
    whole = lambda n: n.cast("string")
    near = lambda n, unit: whole(F.floor(n / unit + 0.5).cast("long"))
    return (
        F.when(seconds.isNull(), "—").when((r < 60) & (seconds < 10), F.concat(_fixed(seconds, 1), F.lit("s"))).when(r < 60, F.concat(_fixed(seconds, 0), F.lit("s")))
        .when(r < 3600, F.concat(whole(F.floor(r / 60)), F.lit("m "), whole(r % 60), F.lit("s")))
        .when(r < 86400, F.concat(whole(F.floor(r / 3600)), F.lit("h "), near(r % 3600, 60), F.lit("m")))
        .otherwise(F.concat(whole(F.floor(r / 86400)), F.lit("d "), near(r % 86400, 3600), F.lit("h")))
    )


def _trimmed(x: Column, places: int) -> Column:
    full = F.format_number(x, places)
    return F.regexp_replace(F.regexp_replace(full, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_number(value: Column) -> Column:
    """One decimal at most; thousands grouped; compact (M, B, T) from a million."""
    size = F.abs(value)
    compact = lambda by, unit: F.concat(_trimmed(value / by, 1), F.lit(unit))
    return F.when(value.isNull(), "—").when(size >= 999_950_000_000, compact(1e12, "T")).when(size >= 999_950_000, compact(1e9, "B")).when(size >= 1_000_000, compact(1e6, "M")).otherwise(_trimmed(value, 1))


def format_tempdb_pages(pages: Column) -> Column:
    """Pages of 8 KB, with their size in MB or GB."""
    mb = pages * 8 / 1024
    size = F.when(mb >= 1024, F.concat(_trimmed(mb / 1024, 2), F.lit(" GB"))).otherwise(F.concat(_trimmed(mb, 2), F.lit(" MB")))
    return F.when(pages.isNull(), "—").otherwise(F.concat(format_number(pages), F.lit(" pages ("), size, F.lit(")")))


def format_ratio(value: Column) -> Column:
    return F.when((value > 0) & (value < 0.01), "<0.01×").otherwise(F.concat(format_number(value), F.lit("×")))


def counter_label(label: str, original: Column, delta: str, cumulative: str) -> Column:
    """Whether a counter of the raw row is a reported delta, cumulative or neither."""
    has_delta = as_number(F.element_at(original, delta)).isNotNull()
    return F.when(has_delta, f"{label} (reported delta)").when(F.map_contains_key(original, cumulative), f"{label} (cumulative)").otherwise(label)


def original_number(original: Column, aliases: list[str]) -> Column:
    """The first alias that is in the raw row and numeric; names are compared without punctuation and case."""
    plain = F.transform_keys(original, lambda k, _: F.regexp_replace(F.lower(k), "[^a-z0-9]+", ""))
    cell = lambda a: F.replace(F.trim(F.element_at(plain, "".join(c for c in a.lower() if c.isalnum()))), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(*map(cell, aliases))


def handle_norm(value: Column) -> Column:
    """A handle or hash: trimmed, lower case, without 0x; null if empty."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(value)), "^0x", ""), F.lit(""))


def evidence_digits(value: Column) -> Column:
    """A text without commas and a unit at the end."""
    bare = F.replace(value, F.lit(","), F.lit(""))
    plain = F.right(F.trim(value), F.lit(1)).between("0", "9")  # no unit to look for
    return F.trim(F.when(plain, bare).otherwise(F.regexp_replace(bare, r"(?i)\s*(kb|mb|gb|ms|s|%)\s*$", "")))


def evidence_number(value: Column) -> Column:
    """A number that is the whole text, once commas and a unit at the end are gone."""
    return plain_number(evidence_digits(value))


# Pages of 8 KB to a unit, and what else units are called.
PAGES = {"pages": 1.0, "bytes": 1 / 8192, "kb": 1 / 8, "kib": 1 / 8, "mb": 128.0, "mib": 128.0, "gb": 131072.0, "gib": 131072.0}
_CALLED = {u: u for u in PAGES} | {"page": "pages", "byte": "bytes"} | {f"8{k}{p}": "pages" for k in ("k", "kb") for p in ("", "page", "pages")}
# Milliseconds of a unit of time, by its names.
_MS = {n: 1.0 for n in ("ms", "msec", "msecs", "millisecond", "milliseconds")} | {n: 1000.0 for n in ("s", "sec", "secs", "second", "seconds")} | {n: 60_000.0 for n in ("min", "mins", "minute", "minutes")}
_MS |= {n: 3_600_000.0 for n in ("hour", "hours", "hr", "hrs")} | {n: 86_400_000.0 for n in ("day", "days")}


def spill_text(value: Column) -> Column:
    """A trimmed cell of a spill export; null if it is empty or says that there is no value."""
    t = F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
    return F.when((t != "") & ~F.lower(t).isin(*NOT_GIVEN), t)


def spill_number(value: Column, column_unit: str = "pages") -> Column:
    """struct<value, state, explanation>: a number that is not negative, in pages, with an optional unit that must be the column's."""

    def parts(t: Column) -> Column:
        number = F.regexp_extract(t, r"^[+]?[0-9.]+([eE][+-]?[0-9]+)?", 0)
        said = F.lower(F.regexp_replace(F.substring(t, F.length(number) + 1, F.length(t)), r"\s+", ""))
        return F.struct(F.when(number.rlike("[0-9]$"), number.try_cast("double")).alias("n"), F.when(said != "", F.coalesce(_lookup(_CALLED, said), F.lit("?"))).alias("unit"))

    def judged(p: Column) -> Column:
        wrong, other = p["n"].isNull() | F.coalesce(p["unit"] == "?", F.lit(False)), p["unit"] != column_unit
        pages = p["n"] * PAGES[column_unit]
        state = F.when(wrong | F.coalesce(other, F.lit(False)), "invalid").when(pages <= 0, "zero-or-nonpositive").otherwise("imported")
        why = F.when(wrong, "not a number with a known unit").when(other, F.concat(F.lit("the cell says "), p["unit"], F.lit(f", the column {column_unit}")))
        return F.struct(F.when(state != "invalid", pages).alias("value"), state.alias("state"), why.alias("explanation"))

    absent = F.struct(F.lit(None).cast("double").alias("value"), F.lit("missing").alias("state"), F.lit(None).cast("string").alias("explanation"))
    return _once(F.replace(spill_text(value), F.lit(","), F.lit("")), lambda t: F.when(t.isNull(), absent).otherwise(_once(parts(t), judged)))


def spill_duration_ms(value: Column) -> Column:
    """Milliseconds of h:m:s or of a sum of amounts with units that fill the text."""
    t = spill_text(value)
    p = F.split(t, ":")
    at = lambda i: F.when(p[i].rlike("^[0-9]+([.][0-9]+)?$" if i == 2 else "^[0-9]+$"), p[i].try_cast("double"))
    clock = F.when((F.size(p) == 3) & (at(1) < 60) & (at(2) < 60), ((at(0) * 60 + at(1)) * 60 + at(2)) * 1000)
    term = r"\+?([0-9]*\.?[0-9]+)\s*([A-Za-z]+)"
    units = F.transform(F.regexp_extract_all(t, F.lit(term), 2), lambda u: _lookup(_MS, F.lower(u)))
    terms = F.zip_with(F.regexp_extract_all(t, F.lit(term), 1), units, lambda n, u: n.try_cast("double") * u)
    filled = F.regexp_replace(F.regexp_replace(t, term, ""), r"[,\s]+", "") == ""
    # an amount of an unknown unit makes the sum null
    return F.coalesce(clock, F.when(filled & (F.size(terms) > 0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def metric_state(raw: Column, number: Column) -> Column:
    """What became of a cell: missing, invalid, zero or less, or imported."""
    return F.when(spill_text(raw).isNull(), "missing").when(number.isNull() | (number < 0), "invalid").when(number <= 0, "zero-or-nonpositive").otherwise("imported")


def spill_gib(pages: Column) -> Column:
    return pages * 8 / 1024 / 1024


def last_execution(value: Column) -> Column:
    """A timestamp kept to its fraction, with a blank or a T; else as month, day and year, or by the names of months."""
    t = spill_text(value)
    forms = [F.try_to_timestamp(t, F.lit(f)) for f in ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy", "MMM d yyyy h:mma", "d MMM yyyy HH:mm:ss")]
    return F.coalesce(as_timestamp(t), *forms)


def flag_value(value: Column, capability: bool = False) -> Column:
    t = F.lower(as_text(value))
    yes, no = ["1", "true", "y", "yes"], ["0", "false", "n", "no"]
    if capability:
        yes, no = [*yes, "on", "granted"], [*no, "off", "denied"]
    return F.when(t.isin(*yes), True).when(t.isin(*no), False)


def clean_identifier(value: Column) -> Column:
    """A trimmed identifier without its brackets, ]] being ]; null if empty."""
    t = as_text(value)
    bare = F.when(t.rlike(r"^\[[\s\S]*\]$"), F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("]]"), F.lit("]"))).otherwise(t)
    return F.nullif(F.trim(bare), F.lit(""))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def portable_key(database: Column, schema: Column, table: Column, index: Column) -> Column:
    """database|schema|table|index in NFKC and lower case; <table> where there is no index."""
    part = lambda c: F.lower(F.trim(_nfkc(c)))
    return F.concat_ws("|", part(database), part(schema), part(table), part(F.coalesce(index, F.lit("<table>"))))


def server_fingerprint(name: Column) -> Column:
    return F.sha2(F.lower(F.trim(name)), 256)


def csv_safe_cell(value: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def optimizer_token(value: Column) -> Column:
    return F.when(value.rlike(r"^[A-Za-z0-9_.:-]{1,128}$"), value).otherwise("[redacted]")


def header_norm_capture(value: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "^﻿", ""))
    return F.regexp_replace(F.regexp_replace(t, r"^\[|\]$", ""), r"\s+", " ")


def _snake(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_|_$", "")


def header_norm_counter(value: Column) -> Column:
    return _snake(F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "^\ufeff", ""))))


def header_norm_evidence(value: Column) -> Column:
    return _snake(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[%/]+", " "))


def header_norm_spill(value: Column) -> Column:
    """Words of mixed case are parted, # is number, 8 KB units are pages, and pages are said once."""
    t = F.lower(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "([a-z0-9])([A-Z])", "$1_$2"))
    snake = _snake(F.regexp_replace(F.replace(t, F.lit("#"), F.lit(" number ")), r"8\s*kb?(\s*pages?)?", " pages "))
    return F.regexp_replace(snake, "(pages_)+pages", "pages")
