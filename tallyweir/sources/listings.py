"""Listings of companies and filings as sources deliver them: JSON payloads, title grammars, choice of the newest report, stray formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits of years in Chinese, and the words of the title grammar below.
YEAR_DIGITS = {"零": "0", "〇": "0", "○": "0", "Ｏ": "0", "О": "0", "一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9"}
NOT_BEFORE_TITLE = ("关于", "更正", "补充", "说明", "通知", "提示", "H股", "意见", "审核", "核查", "董事会", "监事会", "独立", "半年", "季度", "问询", "回复", "英文", "取消", "公告", "摘要")
REVISED = ("更新", "修订", "更正", "补充", "修正")
CANCELLED = ("取消", "废止", "作废")
ANNUAL_FORMS = ("10-K", "20-F", "40-F")
TRANSITION_FORMS = {"10-KT": "10-K", "20-FT": "20-F"}
# Forms by which sources mark a company's yearly report.
YEARLY_CODES = {"edinet_list": "030000", "dart_list": "A001", "cninfo_query": "category_ndbg", "sec_index": "10-K"}

# The forms that a year and a yearly report's name take in titles.
_YEAR = "(?:(?:19|20)[0-9]{2}|[一二][" + "".join(YEAR_DIGITS) + "0]{3})"
_REPORT = r"年?\s*度\s*报\s*告"
_SHORT = r"年?\s*报(?!\s*告)"
_RESULTS = r"年?\s*度\s*业\s*绩\s*(?:公\s*告|报\s*告)"


def flat_title(col: Column) -> Column:
    """A title without tags, brackets and colons in one form, blanks single."""
    bare = F.translate(F.regexp_replace(col, r"<[^>]+>", ""), "（）【】：", "()():")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def chinese_year(col: Column) -> Column:
    """A year in figures or in Chinese digits as a number, else null."""
    written = F.translate(F.regexp_replace(col, r"\s+", ""), "".join(YEAR_DIGITS), "".join(YEAR_DIGITS.values()))
    return F.when(written.rlike("^[0-9]{4}$"), written.cast("int"))


def title_parts(title: Column) -> Column:
    """struct(year, kind, english, cancelled, revision) of the title of a company's own yearly report in Chinese or its summary; null for
    anything else: other periods, notices, opinions, copies for other exchanges, another company's report."""
    t = flat_title(title)
    grammar = rf"^(.*?)({_YEAR})\s*年\s*(?:({_REPORT})|({_SHORT})|({_RESULTS}))(.*)$"
    part = lambda k: F.regexp_extract(t, grammar, k)
    prefix, year, results, rest = F.trim(part(1)), chinese_year(part(2)), part(5), F.trim(part(6))
    summary_first = F.startswith(rest, F.lit("摘要"))
    bracketed = F.startswith(rest, F.lit("(")) & F.contains(F.substring(rest, 1, 12), F.lit("摘要")) & (results == "")
    kind = F.when((results != "") | summary_first | bracketed, "summary").otherwise("full")
    tail = F.when(summary_first, F.trim(F.substring(rest, 3, 2_000_000))).otherwise(rest)
    has = lambda c, words: c.rlike("|".join(words))
    superseded = tail.rlike("(?:" + "|".join(REVISED) + ")前")
    own = (
        t.rlike(grammar) & year.between(1990, 2100) & ~F.lower(t).rlike("h股|annual report") & (F.length(prefix) <= 40) & ~has(prefix, NOT_BEFORE_TITLE)
        & ~prefix.rlike(r":.*[^ \-—_]") & tail.rlike(r"(?i)^(?:全文|正文|\([^()]{0,20}\)|[\s\-—_:：、]|english|version)*$")
    )
    return F.when(
        own,
        F.struct(
            year.alias("year"), kind.alias("kind"), F.lower(tail).rlike("英文|english").alias("english"),
            (has(tail, CANCELLED) | superseded).alias("cancelled"), (has(tail, REVISED) & ~superseded).alias("revision"),
        ),
    )


def looks_yearly(title: Column) -> Column:
    """The year of a title that looks like a yearly report, whether or not its grammar is understood; null otherwise."""
    return chinese_year(F.nullif(F.regexp_extract(flat_title(title), rf"({_YEAR})\s*年.{{0,3}}?(?:年报|度报告|度业绩)", 1), F.lit("")))


def newest_reports(filings: DataFrame, company: str, title: str, at: str, filing: str) -> DataFrame:
    """(company, year, kind, filing, revision): the report of each kind for the newest year of each company.

    A revision goes before its original, then the latest, then the greater id. Cancelled and English copies don't count. Where a title
    that looks like the report of a newer year is not understood, the company has no row rather than an older year's.
    """
    read = filings.where(F.col(company).isNotNull()).select(F.col(company).alias("company"), F.col(filing).alias("filing"), F.col(at).alias("at"), title_parts(F.col(title)).alias("t"), looks_yearly(F.col(title)).alias("loose"))
    usable = F.col("t").isNotNull() & ~F.col("t.english") & ~F.col("t.cancelled")
    best = F.struct("t.revision", "at", "filing")
    kinds = read.where(usable).groupBy("company", "t.year", "t.kind").agg(F.max(best).alias("b"))
    years = read.groupBy("company").agg(F.max(F.when(usable, F.col("t.year"))).alias("newest"), F.max(F.when(F.col("t").isNull(), F.col("loose"))).alias("unread"))
    settled = years.where(F.col("newest").isNotNull() & ~F.coalesce(F.col("unread") > F.col("newest"), F.lit(False))).select("company", F.col("newest").alias("year"))
    return kinds.join(settled, ["company", "year"]).select(F.col("company").alias(company), "year", "kind", F.col("b.filing").alias(filing), F.col("b.revision").alias("revision"))


def base_form(form: Column) -> Column:
    """A form without its amendment mark, transition reports as the form they stand for."""
    plain = F.regexp_replace(F.upper(F.trim(form)), "/A$", "")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TRANSITION_FORMS.items() for x in kv])[plain], plain)


def latest_annual_filing(filings: DataFrame, company: str, form: str, filed: str, filing: str, wanted: tuple[str, ...] = ANNUAL_FORMS) -> DataFrame:
    """(company, filing, form, amendment): the newest original of the wanted forms, an amendment only where there is no original."""
    rows = filings.where(base_form(F.col(form)).isin(*wanted) & F.col(filing).isNotNull() & F.col(company).isNotNull())
    original = ~F.upper(F.trim(form)).endswith("/A")
    best = F.max_by(F.struct(F.col(filing).alias("filing"), F.col(form).alias("form"), (~original).alias("amendment")), F.struct(original, F.col(filed), F.col(filing))).alias("b")
    return rows.groupBy(company).agg(best).select(company, F.col("b.filing").alias(filing), F.col("b.form").alias(form), "b.amendment")


def parse_columnar(payload: Column, schema: str, fields: str = "fields", data: str = "data") -> Column:
    """Array of structs of a payload {"fields": [...], "data": [[...], ...]}; ``schema`` names the wanted fields and their types as DDL.

    Rows are strings inside JSON until they are cast, so a field may be absent, in any place and of any JSON type; what can't be cast is null.
    """
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(schema)
    read = F.from_json(payload, f"struct<{fields}: array<string>, {data}: array<array<string>>>")
    place = {f.name: F.array_position(read[fields], f.name) for f in wanted.fields}

    def row(cells: Column) -> Column:
        return F.struct(*[F.when(place[f.name] > 0, F.try_element_at(cells, place[f.name].cast("int"))).try_cast(f.dataType).alias(f.name) for f in wanted.fields])

    return F.transform(read[data], row)


def plain_ticker(col: Column) -> Column:
    """A ticker in capitals with one hyphen wherever its class is set off, however the source does it."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.upper(F.trim(col)), r"[.\s/_]+", "-"), "-{2,}", "-"), F.lit("-"))


def republic_date(col: Column) -> Column:
    """A date of the Republic's calendar (113/05/02, 113.5.2 or 1130502) as a date, else null."""
    bare = F.trim(col)
    parts = [F.regexp_extract(bare, r"^([0-9]{2,3})[/.\-]([0-9]{1,2})[/.\-]([0-9]{1,2})", k) for k in (1, 2, 3)]
    packed = [F.regexp_extract(bare, r"^([0-9]{3})([0-9]{2})([0-9]{2})$", k) for k in (1, 2, 3)]
    y, m, d = (F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))) for a, b in zip(parts, packed))
    return F.try_to_date(F.concat_ws("-", F.lpad((y.cast("int") + 1911).cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def finite(col: Column) -> Column:
    """A number that is one: null for what is not a number or infinite."""
    return F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col)


def listing_key(isin: Column, security: Column) -> Column:
    """What groups the lines of a company: its ISIN where that has twelve characters, else the line itself."""
    bare = F.trim(isin)
    return F.when(F.length(bare) == 12, F.concat(F.lit("isin:"), bare)).otherwise(F.concat(F.lit("sec:"), security))


def short_code(code: Column) -> Column:
    """A five-character code as its four-character symbol where a zero only fills it up."""
    return F.when((F.length(code) == 5) & code.endswith("0"), F.substring(code, 1, 4)).otherwise(code)


def canonical_id(security: Column, venues: dict[str, str], strip_zeros: tuple[str, ...] = ()) -> Column:
    """VENUE:SYMBOL in capitals, venues under one name, leading zeros dropped on the venues that fill up with them."""
    upper = F.upper(F.trim(security))
    venue, symbol = F.substring_index(upper, ":", 1), F.substring(upper, F.instr(upper, ":") + 1, F.length(upper))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in venues.items() for x in kv])[venue], venue) if venues else venue
    return F.when(F.contains(upper, F.lit(":")), F.concat_ws(":", named, F.when(named.isin(*strip_zeros), F.ltrim(symbol, F.lit("0"))).otherwise(symbol))).otherwise(upper)
