"""Format-preserving pseudonyms for personal numbers and dates, with DataFrame functions only.

Candidates are found by one pattern and validated: payment cards by their check digit, national ids, telephone numbers
and network addresses by their ranges, dates by the calendar. The value, without its separators, is permuted by a keyed
Feistel network on exactly the set of valid values of its format, so a pseudonym is valid too, two values never share
one, and equal values get equal pseudonyms in all documents, however they are punctuated. No tables are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROUNDS = 10
_LEFT, _RIGHT = r"(?<![\p{L}0-9_.%+-])", r"(?![\p{L}0-9_]|[-.+@][\p{L}0-9])"
_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_CARD = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_NANP = r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}"
_E164 = r"\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,5}\)?){2,6}"
_IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_YMD = r"(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}[-/.][0-9]{1,2}"
_DMY = r"[0-9]{1,2}([-/.])[0-9]{1,2}[-/.](?:19|20)[0-9]{2}"
_ANY = _LEFT + "(?:" + "|".join([_EMAIL, _NANP, _E164, _CARD, _SSN, _IPV4, _YMD.replace("([", "[").replace("])", "]", 1), _DMY.replace("([", "[").replace("])", "]", 1)]) + ")" + _RIGHT
#: Days from 1900-01-01 to 2099-12-31, as a product of two whole numbers.
_DAYS = (17, 4297)


def _long(x) -> Column:
    return (F.lit(x) if not isinstance(x, Column) else x).cast("long")


def feistel(left: Column, right: Column, a, b, key: str, tag: str, tweak: Column | None = None) -> Column:
    """The keyed permutation of Z_a x Z_b at (left, right), as a struct of left and right."""
    a, b = _long(a), _long(b)

    def mask(number, value, size):
        text = F.concat_ws("|", F.lit(key), F.lit(tag), a.cast("string"), b.cast("string"), *([tweak] if tweak is not None else []), number.cast("string"), value.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size)

    def turn(s, i):
        new_left = F.pmod(s["left"] + mask(i * 2, s["right"], a), a)
        inner = F.struct(new_left.alias("left"), s["right"].alias("right"))
        # the second half needs the new left side once more: an array of one element names it
        return F.transform(F.array(inner), lambda t: F.struct(t["left"].alias("left"), F.pmod(t["right"] + mask(i * 2 + 1, t["left"], b), b).alias("right")))[0]

    start = F.struct(_long(left).alias("left"), _long(right).alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS // 2)), start, turn)


def _named(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _relay(shape: Column, fresh: Column, kind: str = "[0-9]") -> Column:
    """shape with its characters of this kind replaced by those of fresh, in order; capitals stay capitals where they can."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s, c):
        hit = c.rlike(kind)
        new = F.substring(fresh, s["at"], 1)
        return F.struct(F.concat(s["out"], F.when(hit & (c != F.lower(c)), F.upper(new)).when(hit, new).otherwise(c)).alias("out"), (s["at"] + hit.cast("int")).alias("at"))

    return F.aggregate(F.regexp_extract_all(shape, F.lit(r"([\s\S])"), 1), start, put, lambda s: s["out"])


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0"))


def _pow10(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**i).cast("long") for i in range(19))), (n + 1).cast("int"))


def permute_digits(d: Column, key: str, tag: str) -> Column:
    """A string of 2 to 36 digits, permuted within its length."""
    half = F.floor(F.length(d) / 2).cast("int")
    rest = F.length(d) - half
    out = feistel(F.substring(d, F.lit(1), half), F.substring(d, half + 1, rest), _pow10(half), _pow10(rest), key, tag)
    return _named(out, lambda s: F.concat(_pad(s["left"], half), _pad(s["right"], rest)))


def luhn_sum(d: Column) -> Column:
    """The sum of the Luhn formula over a string of digits, its last one being the check digit."""
    n = F.length(d)

    def add(s, i):
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return s + F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def fresh(d):
        body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _named(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    valid = lambda d: (F.pmod(luhn_sum(d), F.lit(10)) == 0) & (d.cast("decimal(20,0)") > 0)
    return _named(_digits(m), lambda d: F.when(valid(d), _relay(m, fresh(d))).otherwise(m))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    # areas 1 to 665 and 667 to 899 are numbered from 0
    place = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    out = feistel(place, serial - 1, 898 * 99, 9999, key, "ssn")

    def show(s):
        a = F.floor(s["left"] / 99)
        return F.concat_ws("-", _pad(a + F.when(a >= 665, 2).otherwise(1), 3), _pad(s["left"] % 99 + 1, 2), _pad(s["right"] + 1, 4))

    return F.when(valid, _named(out, show)).otherwise(m)


def _nanp(m: Column, key: str) -> Column:
    """Area and exchange begin with 2 to 9: 800 * 800 * 10000 numbers, which is 80000 squared."""

    def fresh(d):
        ten = F.right(d, F.lit(10))
        value = (F.substring(ten, 1, 3).cast("long") - 200) * 8_000_000 + (F.substring(ten, 4, 3).cast("long") - 200) * 10_000 + F.substring(ten, 7, 4).cast("long")
        out = _named(value, lambda v: feistel(F.floor(v / 80_000), v % 80_000, 80_000, 80_000, key, "nanp"))
        whole = lambda s: s["left"] * 80_000 + s["right"]
        show = lambda v: F.concat(_pad(F.floor(v / 8_000_000) + 200, 3), _pad(F.floor(v / 10_000) % 800 + 200, 3), _pad(v % 10_000, 4))
        return F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _named(_named(out, whole), show))

    return _named(_digits(m), lambda d: _relay(m, fresh(d)))


def _e164(m: Column, key: str) -> Column:
    """The first three digits, which hold the country, stay."""
    fresh = lambda d: F.concat(F.substring(d, 1, 3), permute_digits(F.substring(d, F.lit(4), F.length(d) - 3), key, "e164"))
    return _named(_digits(m), lambda d: F.when(F.length(d).between(8, 15), _relay(m, fresh(d))).otherwise(m))


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    valid = F.forall(o, lambda x: x <= 255)

    def show(x):
        s = feistel(x[0] * 256 + x[1], x[2] * 256 + x[3], 65_536, 65_536, key, "ipv4")
        return _named(s, lambda t: F.concat_ws(".", F.floor(t["left"] / 256), t["left"] % 256, F.floor(t["right"] / 256), t["right"] % 256))

    return _named(o, lambda x: F.when(valid, show(x)).otherwise(m))


def _date(m: Column, key: str) -> Column:
    """Year first, day first, or month first where day first is no date; the separators and the order stay. Day and month
    have the widths they had; a number of two digits takes two."""
    sep = F.regexp_extract(m, "[0-9]+([-/.])", 1)
    part = lambda i: F.split(m, "[-/.]")[i]
    iso = lambda y, mo, d: F.try_to_timestamp(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    year_first = m.rlike("^[0-9]{4}")
    ymd, dmy, mdy = iso(part(0), part(1), part(2)), iso(part(2), part(1), part(0)), iso(part(2), part(0), part(1))
    day = F.when(year_first, ymd).otherwise(F.coalesce(dmy, mdy))
    shape = F.when(year_first, "y").when(dmy.isNotNull(), "d").when(mdy.isNotNull(), "m")

    def show(n):
        s = feistel(F.floor(n / _DAYS[1]), n % _DAYS[1], *_DAYS, key, "date")
        fresh = _named(s, lambda t: F.date_add(F.lit("1900-01-01").cast("date"), (t["left"] * _DAYS[1] + t["right"]).cast("int")))
        wide = lambda x, i: F.when(F.length(part(i)) == 2, _pad(x, 2)).otherwise(x.cast("string"))
        parts = lambda *x: F.concat(*(c for i, y in enumerate(x) for c in (*((sep,) if i else ()), y.cast("string"))))
        day_of, month, year = F.dayofmonth, F.month, F.year
        return _named(fresh, lambda f: F.when(shape == "y", parts(year(f), wide(month(f), 1), wide(day_of(f), 2))).when(shape == "d", parts(wide(day_of(f), 0), wide(month(f), 1), year(f))).otherwise(parts(wide(month(f), 0), wide(day_of(f), 1), year(f))))

    number = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
    return _named(number, lambda n: F.when(n.isNotNull() & (n >= 0) & (n < _DAYS[0] * _DAYS[1]), show(n)).otherwise(m))


def _email(m: Column, key: str) -> Column:
    """The letters and digits of the local part are permuted in base 36 within their number, whatever their case, which is
    laid over the result; the domain stays. Beyond 22 of them, the last ones tweak the permutation of the first 22 and are then permuted on their own."""
    local, domain = F.regexp_extract(m, "^([^@]+)@", 1), F.regexp_extract(m, "(@.*)$", 1)
    pow36 = lambda n: F.element_at(F.array(*(F.lit(36**i).cast("long") for i in range(12))), (n + 1).cast("int"))

    def base36(s, tweak, tag):
        half = F.floor(F.length(s) / 2).cast("int")
        rest = F.length(s) - half
        value = lambda x: F.coalesce(F.conv(F.when(F.length(x) > 0, x), 36, 10).cast("long"), F.lit(0).cast("long"))
        out = feistel(value(F.substring(s, F.lit(1), half)), value(F.substring(s, half + 1, rest)), pow36(half), pow36(rest), key, tag, tweak)
        show = lambda x, n: F.lpad(F.lower(F.conv(x.cast("string"), 10, 36)), n, F.lit("0"))
        return _named(out, lambda t: F.concat(show(t["left"], half), show(t["right"], rest)))

    def fresh(s):
        head, mid, tail = F.substring(s, 1, 22), F.substring(s, 23, 22), F.substring(s, 45, 22)
        return F.concat(base36(head, F.concat(mid, tail), "mail1"), base36(mid, tail, "mail2"), base36(tail, F.lit(""), "mail3"))

    return _named(local, lambda x: F.concat(_relay(x, fresh(F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))), "[A-Za-z0-9]"), domain))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate; the candidate itself if it is not valid."""
    is_a = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), _email(m, key)).when(is_a(_IPV4), _ipv4(m, key)).when(is_a(_SSN), _ssn(m, key))
        .when(is_a(_YMD) | is_a(_DMY), _date(m, key)).when(is_a(_NANP), _nanp(m, key)).when(m.startswith("+"), _e164(m, key))
        .when(is_a(_CARD), _card(m, key)).otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_pseudonyms") -> DataFrame:
    """docs with the personal numbers, dates and mail addresses of its text replaced, and their number in the column count.

    All other text stays as it is, whole texts are searched, and every row and column is kept (a column of the name count
    is replaced). A null text stays null, with 0; an empty one stays empty. key is the secret; the same key gives the same
    pseudonyms in every run. An empty table gives an empty table.
    """
    marked = docs.withColumn("__marks", F.regexp_extract_all(F.col(text), F.lit(_ANY), 0))
    found = marked.withColumn("__fresh", F.when(F.size("__marks") > 0, F.transform("__marks", lambda m: pseudonym(m, key))))
    whole = F.array_join(F.zip_with(F.split(F.col(text), _ANY, -1), F.col("__fresh"), lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip("__marks", "__fresh"), lambda z: z["__marks"] != z["__fresh"]))
    out = found.withColumn(count, F.when(F.col("__fresh").isNotNull(), changed).otherwise(0).cast("long"))
    return out.withColumn(text, F.when(F.col("__fresh").isNotNull(), whole).otherwise(F.col(text))).drop("__marks", "__fresh")
