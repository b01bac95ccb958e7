"""Single fields put right or told apart: marks in names, places, numbers as words, web hosts, years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Figures of counting in Chinese.
HAN_NUMBERS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key] if table else F.lit(None).cast("string")


def risk_mark(name: Column) -> Column:
    """star_st for names marked *ST (S*ST), st for ST, in either width; null for others."""
    narrow = F.translate(F.trim(name), "＊ＳＴ", "*ST")
    return F.when(narrow.rlike(r"^S?\*ST"), "star_st").when(narrow.rlike(r"^S?ST"), "st")


def region_for(country: Column, exchange: Column, by_country: dict[str, str], by_exchange: dict[str, str], offshore: tuple[str, ...] = (), default: str = "Other") -> Column:
    """A line's region: its country's unless that is a mere seat, else its venue's, else what the country still tells."""
    place = F.trim(country)
    home = _lookup(by_country, place)
    return F.coalesce(F.when(~place.isin(*offshore, ""), home), _lookup(by_exchange, exchange), home, F.lit(default))


def in_places(country: Column, region: Column, wanted: list[str], codes: dict[str, str], known: set[str]) -> Column:
    """Whether a row lies in the places of a list of codes, country names or regions; an unknown word in the list is an error."""
    regions = {w for w in wanted if w not in known and w not in codes}
    unknown = [w for w in regions if w != w.strip() or not w]
    if unknown:
        raise ValueError(f"unknown places: {unknown}")
    names = [codes.get(w, w) for w in wanted]
    return F.coalesce(country.isin(*names), F.lit(False)) | F.coalesce(region.isin(*names), F.lit(False))


def host_kind(url: Column, official: tuple[str, ...], gray: tuple[str, ...], third_party: tuple[str, ...]) -> Column:
    """missing, gray, official, third_party or company by an address's host and the hosts above it."""
    host = F.lower(F.nullif(F.regexp_extract(F.trim(url), r"^(?i:[a-z][a-z0-9+.\-]*://)?(?:[^@/]*@)?([^:/?#\s]+\.[^:/?#\s]+)", 1), F.lit("")))
    under = lambda hosts: F.coalesce(host.rlike("(?:^|\\.)(?:" + "|".join(h.replace(".", "\\.") for h in hosts) + ")$"), F.lit(False)) if hosts else F.lit(False)
    anywhere = host.rlike("|".join(h.replace(".", "\\.") for h in gray)) if gray else F.lit(False)
    return F.when(host.isNull(), "missing").when(anywhere, "gray").when(under(official), "official").when(under(third_party), "third_party").otherwise("company")


def money_words(value: Column) -> Column:
    """1.2T, 3.4B, 5.6M, or whole units with commas; a dash for null."""
    size = F.abs(value)
    short = lambda unit, power: F.concat(F.format_string("%.1f", value / 10.0**power), F.lit(unit))
    return F.when(value.isNull(), "-").when(size >= 1e12, short("T", 12)).when(size >= 1e9, short("B", 9)).when(size >= 1e6, short("M", 6)).otherwise(F.format_string("%,.0f", value))


def lower_floor(value: Column) -> Column:
    """98 % of a value, cut to two figures; 0 for what is not positive."""
    v = F.floor(value * 0.98)
    step = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.length(v.cast("string")) - 2)).cast("bigint")
    return F.when(v > 0, (v - v % step).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def fiscal_year(report_date: Column, filing_date: Column) -> Column:
    return F.year(F.coalesce(report_date, filing_date))


def latest_due_year(day: Column) -> Column:
    """The newest year whose report must be out by a day, the deadline being 30 April."""
    past = (F.month(day) > 4) | ((F.month(day) == 4) & (F.dayofmonth(day) > 30))
    return F.year(day) - F.when(past, 1).otherwise(2)


def han_number(col: Column) -> Column:
    """A number from 1 to 99 in Chinese, else null."""
    one, tens = F.regexp_extract(col, "^([一二三四五六七八九])$", 1), r"^([一二三四五六七八九]?)十([一二三四五六七八九]?)$"
    digit = lambda c: _lookup(HAN_NUMBERS, c)
    many = F.coalesce(digit(F.regexp_extract(col, tens, 1)), F.lit(1)) * 10 + F.coalesce(digit(F.regexp_extract(col, tens, 2)), F.lit(0))
    return F.when(one != "", digit(one)).when(col.rlike(tens), many)


def not_english(text: Column) -> Column:
    """Whether a text is in another script: any Han, kana or Hangul, or Latin letters under half of all; accents and marks don't count."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}]+", ""))
    eastern = text.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")
    return F.coalesce(eastern | ((letters > 0) & (latin * 2 < letters)), F.lit(False))


def slug(text: Column, most: int = 40) -> Column:
    """Latin words and figures joined by hyphens, at most so many characters; the beginning of a hash where there are none."""
    words = F.array_join(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), "-")
    cut = F.btrim(F.substring(words, 1, most), F.lit("-"))
    return F.when(cut != "", cut).otherwise(F.substring(F.sha1(text), 1, 8))
