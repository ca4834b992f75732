"""Security codes, boards and limits as column expressions (F-01 to F-07, F-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(code: Column) -> Column:
    """Six digits, with zeros in front where there are fewer; longer codes stay."""
    return F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)


def exchange(code: Column) -> Column:
    """SH, SZ or BJ of a bare code; the raw length decides between Beijing and padded Shenzhen codes."""
    six, bare = padded(code), F.ltrim(code, F.lit("0"))
    beijing = F.when(F.length(code) == 6, code.rlike("^(4|8|920)")).otherwise(bare.rlike("^[48]") | bare.rlike(r"^92\d\d"))
    return F.when(six.rlike("^(688|6|5|900)"), "SH").when(beijing, "BJ").when(six.rlike("^(30|[012])"), "SZ").when(six.rlike("^9"), "SH").when(six.rlike("^[048]"), "BJ").otherwise("SZ")


def board(code: Column) -> Column:
    six, ex = padded(code), exchange(code)
    return F.when(six.rlike("^688"), "STAR").when((ex == "SH") & six.rlike("^900"), "B").when(ex == "BJ", "BSE").when((ex == "SZ") & six.rlike("^30"), "ChiNext").otherwise("main")


def ts_code(code: Column) -> Column:
    return F.concat(padded(code), F.lit("."), exchange(code))


def index_code(code: Column) -> Column:
    named = F.regexp_replace(F.regexp_replace(code, r"\.XSHG$", ".SH"), r"\.XSHE$", ".SZ")
    return F.when(F.contains(named, F.lit(".")), named).otherwise(F.concat(named, F.lit(".SH")))


def limit_pct(ts: Column, day: Column) -> Column:
    """Price limit of a ts_code on a day; ChiNext has 20 % from 2020-08-24."""
    reformed = day >= F.lit("2020-08-24").cast("date")
    return F.when(F.startswith(ts, F.lit("688")), 0.2).when(F.startswith(ts, F.lit("30")) & reformed, 0.2).when(F.endswith(ts, F.lit(".BJ")), 0.3).otherwise(0.1)


def limit_hit(pct: Column, limit: Column) -> Column:
    return F.when(pct >= limit * 100 - 0.01, "up").when(pct <= -limit * 100 + 0.01, "down").otherwise("none")


# Endings and marks of names that say nothing about likeness, taken out in this order.
NAME_SUFFIXES = ("股份", "集团", "有限", "公司", "ST", "*ST", "退市")


def name_chars(name: Column) -> Column:
    """The distinct characters of a name without suffixes and marks."""
    for s in NAME_SUFFIXES:
        name = F.replace(name, F.lit(s), F.lit(""))
    return F.filter(F.array_distinct(F.split(name, "")), lambda c: c != "")


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the characters of two names without suffixes; 0 where one has none left."""
    chars = name_chars
    return F.coalesce(F.try_divide(F.size(F.array_intersect(chars(a), chars(b))), F.size(F.array_union(chars(a), chars(b)))), F.lit(0.0))


def stamp_tax(day: Column) -> Column:
    """Sale tax rate: fixed steps since 2008-09-19."""
    return F.when(day >= F.lit("2023-08-28").cast("date"), 0.0005).otherwise(0.001)


def prefixed(ts: Column) -> Column:
    """sh.600000 of 600000.SH."""
    return F.concat(F.lower(F.split_part(ts, F.lit("."), F.lit(2))), F.lit("."), F.split_part(ts, F.lit("."), F.lit(1)))


def parsed(ts: Column) -> Column:
    """Struct (symbol, exchange, valid) of a suffixed code; empty parts where it isn't one."""
    form = r"^(\d{6})\.(SH|SZ|BJ)$"
    return F.struct(F.regexp_extract(ts, form, 1).alias("symbol"), F.regexp_extract(ts, form, 2).alias("exchange"), ts.rlike(form).alias("valid"))


# Words in a delisted name, by the reason they stand for, in order.
DELIST_WORDS = {
    "merger": ("吸收合并", "合并"), "acquisition": ("收购",), "bankruptcy": ("破产", "清算"),
    "voluntary": ("主动", "自愿"), "mandatory": ("终止", "强制"), "code_change": ("股改",),
}


def delist_reason(name: Column) -> Column:
    """Reason of a delisting by the first kind of word in the name; a G among its first two letters is a code change."""
    out = F.when(F.lit(False), "")
    for reason, words in DELIST_WORDS.items():
        has = name.rlike("|".join(words))
        out = out.when(has | name.rlike("^.?G") if reason == "code_change" else has, reason)
    return out.otherwise("unknown")


def liability_ratio(assets_to_equity: Column) -> Column:
    return F.when(assets_to_equity > 1, 1 - 1 / assets_to_equity)
