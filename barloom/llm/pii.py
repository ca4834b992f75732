"""Format-preserving pseudonyms for validated numbers, dates and mail addresses, in SQL functions only.

A value is permuted by a keyed Feistel network inside its own format: a card number stays a valid card number of its
length and first digit, a date stays a date written the same way. Equal numbers, however separated, get equal
pseudonyms in every document, and two different ones never share one; a date is a value in its notation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Fixed formats (Java regular expressions), tried in this order at each place.
#: A local part has 64 characters at most; all repetitions are bounded or possessive, so an unbroken run is read once.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,10}[A-Za-z]{2,63}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
#: A space inside a phone number is not one before an IP address, a date, an SSN, a card or a bracket of the next number.
_APART = r"(?! (?:\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)|\d{4}-\d\d-\d\d(?!\d)|\d{1,2}[./]\d{1,2}[./]\d{4}(?!\d)|\d{3}-\d\d-\d{4}(?!\d)|\d{3}-\d{3}-\d{4}(?!\d)|[2-6]\d{3}(?:[ -]\d{4}){3}(?![ -]\d{4}(?![ -]?\d))|3\d{3}[ -]\d{6}[ -]\d{4,5}(?!\d)|\d{13,}))"
_DIGIT = r"[ .()-]{0,2}\d"
_LENGTH = rf"(?<=\+{_DIGIT * 8}{f'(?:{_DIGIT})?' * 7})(?!\w)"
#: Numbers of +1 have ten more digits; others 8 to 15 in all, counted backwards so that a longer run gives its tail back.
PHONE = (
    r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?!\w)|"
    + "|".join(rf"(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,5}}(?:{apart}[ .-]?\d{{2,5}}){{1,4}}{_LENGTH}" for apart in (_APART, ""))
    + r"|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?![\w-])|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])"
)
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"
FIXED = "|".join((EMAIL, IBAN, IPV4, DATE, SSN, PHONE))
#: Where a card may begin and end inside a longer run of digits, and how it is written there.
_CARD_START, _CARD_END = r"(?<![\w.+]|(?<!\d)-)", r"(?!\w|-(?!\d)|\.\d)"
_CARD_INSIDE = r"^(?=\d{4})(?:4|5[0-8]|2[2-7]|3[04-9]|6)\d+(?:[ -]\d{4,})*(?:[ -]\d+)?$"
#: Days in a block of dates, which is permuted in itself: 270 x 270 days from 1900-01-01 and from each block after it.
BLOCK_SIDE, FIRST_DAY = 270, "1900-01-01"
#: Years in a block of dates whose days or months are of a range, and how often their permutation is repeated at most to
#: meet a date: a pair is none with a chance below 0.06, so more are never needed.
BLOCK_YEARS, WALK = 200, 24
#: Fixed country calling codes of two digits; those that begin with 1 or 7 have one, all others three.
COUNTRY_CODES_OF_TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"


def _prf(key: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits: nested SHA-256 with the key inside and outside."""
    inner = F.sha2(F.concat_ws("|", F.lit(f"i{key}"), *parts).cast("binary"), 256)
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"o{key}"), inner).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, kind: Column, key: str) -> Column:
    """A keyed permutation of the pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b, as struct<a, b>."""
    turn = lambda acc, i: F.when(
        i % 2 == 0, F.struct(((acc["a"] + _prf(key, kind, i.cast("string"), acc["b"].cast("string")) % size_a) % size_a).alias("a"), acc["b"].alias("b"))
    ).otherwise(F.struct(acc["a"].alias("a"), ((acc["b"] + _prf(key, kind, i.cast("string"), acc["a"].cast("string")) % size_b) % size_b).alias("b")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _digits(digits: Column, kind: str, key: str) -> Column:
    """A permutation of the digit strings of a length (2 to 36)."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = F.length(digits) - u
    end = feistel(F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1, v).cast("long"), _ten(u), _ten(v), F.concat(F.lit(kind), F.length(digits).cast("string")), key)
    return F.concat(F.lpad(end["a"].cast("string"), u, "0"), F.lpad(end["b"].cast("string"), v, "0"))


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _fill(shape: Column, digits: Column) -> Column:
    """shape with its digits, one after the other, replaced by those given."""
    step = lambda acc, c: F.when(
        c.between("0", "9"), F.struct(F.concat(acc["s"], F.substr(digits, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step)["s"]


def _luhn(digits: Column) -> Column:
    """The check digit that belongs behind the digits."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.try_divide(c.cast("int") * 2, F.lit(10)).cast("int") + (c.cast("int") * 2) % 10).otherwise(c.cast("int"))),
        F.lit(0), lambda s, x: s + x,
    )
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _is_card(x: Column) -> Column:
    d = _only_digits(x)
    return (_luhn(F.substr(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1))) & ~d.rlike(r"^(\d)\1*$")


def _formats(text: Column) -> Column:
    """The formats to look for in a text: the fixed ones, then its own valid card numbers, longest first.

    A run of digits that is no card as a whole is not one to skip: cards are looked for at each group in it.
    """
    at = lambda n: F.regexp_extract_all(text, F.lit(rf"{_CARD_START}(?=(\d(?:[ -]?\d){{{n - 1}}}){_CARD_END})"), F.lit(1))
    whole = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    inside = F.filter(F.concat(*[at(n) for n in range(13, 20)]), lambda c: c.rlike(_CARD_INSIDE))
    cards = F.filter(F.array_distinct(F.concat(whole, inside)), _is_card)
    longest = F.transform(F.sort_array(F.transform(cards, lambda c: F.struct(F.length(_only_digits(c)).alias("n"), c.alias("c"))), asc=False), lambda s: s["c"])
    own = F.concat(F.lit(f"{FIXED}|{_CARD_START}(?:"), F.array_join(longest, "|"), F.lit(f"){_CARD_END}"))
    return F.when(text.rlike(r"\d(?:[ -]?\d){12}") & (F.size(cards) > 0), own).otherwise(F.lit(FIXED))


def _card(x: Column, key: str) -> Column:
    d = _only_digits(x)
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    valid = _is_card(x)
    new = F.concat(F.left(d, F.lit(1)), _digits(F.substr(body, F.lit(2), F.length(body) - 1), "card", key))
    return F.when(valid, _fill(x, F.concat(new, _luhn(new))))


def _phone(x: Column, key: str) -> Column:
    """The country code stays, read from the digits alone, so that separators make no difference; the rest is permuted."""
    d = _only_digits(x)
    two = F.substring(d, 1, 2).isin(*COUNTRY_CODES_OF_TWO.split())
    code = F.when(~F.startswith(x, F.lit("+")), 0).when(F.left(d, F.lit(1)).isin("1", "7"), 1).when(two, 2).otherwise(3)
    rest = F.substr(d, code + 1, F.length(d) - code)
    valid = F.length(d).between(F.when(F.startswith(x, F.lit("+")), 8).otherwise(10), 15)
    return F.when(valid, _fill(x, F.concat(F.substr(d, F.lit(1), code), _digits(rest, "phone", key))))


def _ipv4(x: Column, key: str) -> Column:
    o = F.transform(F.split(x, r"\."), lambda c: c.cast("int"))
    at = lambda i: F.get(o, i).cast("long")
    end = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536), F.lit("ipv4"), key)
    show = lambda e: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(e["a"] / 256), e["a"] % 256, F.floor(e["b"] / 256), e["b"] % 256)])
    return F.when(F.forall(o, lambda c: c <= 255), F.get(F.transform(F.array(end), show), 0))


def _ssn(x: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(x, "-"), i).cast("long")
    area, group, serial = part(0), part(1), part(2)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    end = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)
    show = lambda e: F.concat_ws("-", F.lpad(F.when(e["a"] >= 665, e["a"] + 2).otherwise(e["a"] + 1).cast("string"), 3, "0"), F.lpad((F.floor(e["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((e["b"] % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, F.get(F.transform(F.array(end), show), 0))


def _walked(a: Column, b: Column, size_a: Column, size_b: Column, kind: Column, key: str, valid) -> Column:
    """The permutation of the valid pairs that the one of all pairs gives: it is repeated until it meets a valid pair."""
    step = lambda e, _: F.when(valid(e), e).otherwise(feistel(e["a"], e["b"], size_a, size_b, kind, key))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(a, b, size_a, size_b, kind, key), step)


def _date(x: Column, key: str) -> Column:
    """Years 1900 on; in d/m/yyyy the day is read first, and second where only that is a date.

    A date stays in its notation: ISO; day first with two digits each; month first, which keeps a day above 12, so that it
    can't be read day first; and those with a part of one digit, in which each part keeps its number of digits. Notations
    share no text, and each is permuted in itself, so no two dates get the same text.
    """
    is_iso, slashed = x.rlike(r"^\d{4}-"), F.contains(x, F.lit("/"))
    dotted = F.regexp_replace(x, "/", ".")
    day_first, month_first = F.try_to_date(dotted, "d.M.yyyy"), F.try_to_date(dotted, "M.d.yyyy")
    day = F.when(is_iso, F.try_to_date(x, "yyyy-MM-dd")).otherwise(F.coalesce(day_first, F.when(slashed, month_first)))
    american = ~is_iso & day_first.isNull()
    parts = F.split(dotted, r"\.")
    short = ~is_iso & ((F.length(F.get(parts, F.lit(0))) == 1) | (F.length(F.get(parts, F.lit(1))) == 1))
    mark = F.when(slashed, F.lit("/")).otherwise(F.lit("."))

    # All dates of a block of days, for ISO and for two digits each, day first.
    since, side = F.datediff(day, F.lit(FIRST_DAY).cast("date")), F.lit(BLOCK_SIDE)
    block, inside = F.floor(since / (BLOCK_SIDE * BLOCK_SIDE)), F.pmod(since, F.lit(BLOCK_SIDE * BLOCK_SIDE))
    end = feistel(F.floor(inside / BLOCK_SIDE), inside % BLOCK_SIDE, side, side, F.concat(F.lit("date"), block.cast("string")), key)

    def show(e):
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (e["a"] * BLOCK_SIDE + e["b"] + block * (BLOCK_SIDE * BLOCK_SIDE)).cast("int"))
        return F.when(is_iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "yyyy")))

    # Days and months of a range, in a block of years, for the other notations.
    d, m, y = F.dayofmonth(day), F.month(day), F.year(day)
    from_d = F.when(american, 13).when(d < 10, 1).otherwise(10)
    n_d = F.when(american, 19).when(d < 10, 9).otherwise(22)
    from_m = F.when(american & ~short, 1).when(m < 10, 1).otherwise(10)
    n_m = F.when(american & ~short, 12).when(m < 10, 9).otherwise(3)
    years = F.floor((y - 1900) / BLOCK_YEARS)
    widths = F.concat_ws(",", F.length(F.get(parts, F.lit(0))).cast("string"), F.length(F.get(parts, F.lit(1))).cast("string"))
    kind = F.concat_ws("|", F.when(american, "month first").otherwise("day first"), from_d.cast("string"), from_m.cast("string"), widths, years.cast("string"))
    year_of, month_of, day_of = lambda e: (F.floor(e["a"] / n_m) + 1900 + years * BLOCK_YEARS).cast("int"), lambda e: (e["a"] % n_m + from_m).cast("int"), lambda e: (e["b"] + from_d).cast("int")
    valid = lambda e: day_of(e) <= F.dayofmonth(F.last_day(F.make_date(year_of(e), month_of(e), F.lit(1))))
    walked = _walked((y - 1900 - years * BLOCK_YEARS) * n_m + m - from_m, d - from_d, n_m * BLOCK_YEARS, n_d, kind, key, valid)

    def show_short(e):
        wide = lambda number, place: F.lpad(number.cast("string"), F.length(F.get(parts, F.lit(place))), "0")
        first, second = F.when(american, month_of(e)).otherwise(day_of(e)), F.when(american, day_of(e)).otherwise(month_of(e))
        return F.concat(wide(first, 0), mark, wide(second, 1), mark, year_of(e).cast("string"))

    known = day.isNotNull() & (y >= 1900) & (y < 9800)
    once = lambda e, f: F.get(F.transform(F.array(e), f), 0)
    return F.when(known & (american | short), once(walked, show_short)).when(known, once(end, show))


def _mod97(x: Column) -> Column:
    number = lambda c: F.when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string"))
    return F.aggregate(F.split(F.array_join(F.transform(F.split(x, ""), number), ""), ""), F.lit(0), lambda r, c: (r * 10 + c.cast("int")) % 97)


def _iban(x: Column, key: str) -> Column:
    plain = F.regexp_replace(x, " ", "")
    country, body = F.left(plain, F.lit(2)), F.substr(plain, F.lit(5), F.length(plain) - 4)
    digits = _only_digits(body)
    valid = (_mod97(F.concat(body, F.left(plain, F.lit(4)))) == 1) & F.length(digits).between(6, 30)
    new = _fill(body, _digits(digits, "iban", key))
    check = F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, _fill(x, F.concat(check, _only_digits(new))))


def _shifted(x: Column, by: Column) -> Column:
    """Letters and digits of x moved within their kind by the hex digits of a digest; other characters stay."""
    k = lambda i: F.conv(F.substr(by, F.lit(1) + (i % 32) * 2, F.lit(2)), 16, 10).cast("int")

    def move(c, i):
        kind = lambda low, n: F.char(F.lit(ord(low)) + (F.ascii(c) - ord(low) + k(i)) % n)
        return F.when(c.between("a", "z"), kind("a", 26)).when(c.between("A", "Z"), kind("A", 26)).when(c.between("0", "9"), kind("0", 10)).otherwise(c)

    return F.array_join(F.transform(F.split(x, ""), move), "")


def _email(x: Column, key: str) -> Column:
    """The local part is permuted within its shape, character by character; the domain stays."""
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")
    digest = lambda i, other: F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other).cast("binary"), 256)
    turn = lambda acc, i: F.when(
        i % 2 == 0, F.struct(F.when(F.length(acc["a"]) > 0, _shifted(acc["a"], digest(i, acc["b"]))).otherwise(acc["a"]).alias("a"), acc["b"].alias("b"))
    ).otherwise(F.struct(acc["a"].alias("a"), _shifted(acc["b"], digest(i, acc["a"])).alias("b")))
    start = F.struct(F.substr(local, F.lit(1), half).alias("a"), F.substr(local, half + 1, F.length(local) - half).alias("b"))
    return F.get(F.transform(F.array(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)), lambda e: F.concat(e["a"], e["b"], F.lit("@"), domain)), 0)


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of a matched value, null if it isn't valid in any format."""
    whole = lambda p: x.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(x, F.lit("@")), _email(x, key)).when(whole(IBAN), _iban(x, key)).when(whole(IPV4), _ipv4(x, key)).when(whole(DATE), _date(x, key))
        .when(whole(SSN), _ssn(x, key)).when(whole(PHONE), _phone(x, key)).when(whole(CARD), _card(x, key))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with its texts' validated values replaced by pseudonyms under your key, and n_values, how many were.

    Null texts stay null with n_values 0; empty texts and texts without such values stay as they are; numbers that fail
    their validation (Luhn, mod 97, octets, calendar, number ranges) stay. Repeated rows get equal results. A column
    n_values of docs is replaced.
    """
    found = F.regexp_extract_all(F.col(text), F.col("_formats"), F.lit(0))
    out = docs.drop("n_values").withColumn("_formats", _formats(F.col(text)))
    out = out.withColumn("_values", F.when(F.col(text).rlike("[0-9@]"), F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))))
    out = out.withColumn("n_values", F.coalesce(F.size(F.filter("_values", lambda v: v["new"].isNotNull())), F.lit(0)).cast("long"))
    between = F.split(F.col(text), F.col("_formats"), -1)
    pieces = F.zip_with(between, "_values", lambda p, v: F.concat(p, F.coalesce(v["new"], v["old"], F.lit(""))))
    return out.withColumn(text, F.when(F.col("n_values") > 0, F.array_join(pieces, "")).otherwise(F.col(text))).drop("_values", "_formats")
