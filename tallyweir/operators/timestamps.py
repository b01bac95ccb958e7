"""Mixed timestamp formats and zones to one UTC instant or one plain day (problem 6).

1. A stamp is tokenised into its character-class mask: digits become 9, runs of letters become one class letter.
2. Each mask is mapped to a parser once, through a table generated from the format templates below. A mask that no
   template makes has no parser, so the table's size is that of the templates, never that of the data.
3. A parser says at which places of the masked stamp each field stands; all fields are read with built-in column functions
   that Spark compiles (no function over arrays, which it would interpret row by row).
4. Local times become instants through zone transition tables, one row per zone and local year, made from the IANA
   release named in ``zone_table_version()`` for the zones that occur.
"""

from __future__ import annotations

import calendar
import importlib.metadata
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.session import keep_methods_compiled, ship_package

YEARS = range(1830, 2100)  # of the zone table; see ``table_year`` for others
SLOTS = 8  # offsets of a zone in one year, more than any zone has ever had

# Format templates. Y M D h m s are numbers (M, D, h also with one digit), f a fraction of 1 to 9 digits,
# b a month name, w a weekday name, p a day half, z a zone abbreviation, Z the letter for UTC, o an offset.
DATE_TIME_TEMPLATES = (
    "Y-M-D h:m", "Y-M-D h:m:s", "Y-M-D h:m:s.f", "Y-M-DTh:m", "Y-M-DTh:m:s", "Y-M-DTh:m:s.f",
    "Y/M/D h:m", "Y/M/D h:m:s", "Y.M.D h:m", "Y.M.D h:m:s", "Y. M. D. h:m", "Y. M. D. h:m:s", "Y. M. D. p h:m", "Y. M. D. p h:m:s",
    "Y年M月D日 h時m分", "Y年M月D日 h時m分s秒", "Y年M月D日 h时m分", "Y年M月D日h:m", "Y年M月D日h:m:s", "Y年M月D日 h:m", "Y年M月D日 h:m:s", "Y年M月D日 ph時m分",
    "Y년 M월 D일 h시 m분", "Y년 M월 D일 h:m", "Y년 M월 D일 p h:m", "Y년 M월 D일 p h시 m분",
    "?/?/Y h:m", "?/?/Y h:m:s", "?/?/Y, h:m", "?/?/Y, h:m:s", "?/?/Y h:m p", "?/?/Y h:m:s p", "?/?/Y, h:m p", "?/?/Y, h:m:s p",
    "?-?-Y h:m", "?-?-Y h:m:s", "?-?-Y h:m p", "?-?-Y h:m:s p",
    "D.M.Y h:m", "D.M.Y h:m:s", "D.M.Y, h:m", "D.M.Y, h:m:s", "D.M.Y h:m Uhr", "D.M.Y h:m:s Uhr", "D.M.Y, h:m Uhr", "D.M.Y, h:m:s Uhr",
    "D b Y h:m", "D b Y h:m:s", "D b Y, h:m", "D b Y, h:m:s", "D b Y h:m p", "D b Y, h:m p", "D b Y h:m:s p",
    "D-b-Y h:m", "D-b-Y h:m:s", "D-b-Y h:m p", "D-b-Y h:m:s p",
    "b D, Y h:m", "b D, Y h:m:s", "b D, Y, h:m", "b D, Y, h:m:s", "b D, Y h:m p", "b D, Y h:m:s p", "b D, Y, h:m p", "b D, Y, h:m:s p",
    "w, D b Y h:m", "w, D b Y h:m:s", "w b D h:m:s Y", "w, b D, Y h:m:s",
)
DAY_TEMPLATES = ("Y-M-D", "Y/M/D", "Y.M.D", "Y. M. D.", "Y年M月D日", "Y년 M월 D일", "?/?/Y", "?-?-Y", "D.M.Y", "D b Y", "D-b-Y", "b D, Y", "w, D b Y")
ZONE_SUFFIXES = ("", "Z", " Z", " z", " o", "o", " (z)", " zo")
# Numbers of epochs by their length: the power of ten by which they divide a second.
EPOCH_DIGITS = {10: 0, 13: 3, 16: 6, 19: 9}
# Names of months and of the halves of a day, lower case.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mrz": 3, "mai": 5, "okt": 10, "dez": 12,
}
AFTERNOON, MORNING = ("pm", "p.m.", "오후", "午後", "下午"), ("am", "a.m.", "오전", "午前", "上午")
# Offsets in minutes of zone abbreviations; those that several countries use are told by the country's zone.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "awst": 480, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630,
    "nzst": 720, "nzdt": 780, "sast": 120, "bst": 60, "ist": 330,
}
ABBREVIATIONS_OF = {
    ("cst", "Asia/Shanghai"): 480, ("cst", "Asia/Taipei"): 480, ("ist", "Asia/Kolkata"): 330, ("ist", "Asia/Jerusalem"): 120, ("idt", "Asia/Jerusalem"): 180,
    ("ist", "Europe/Dublin"): 60, ("bst", "Europe/London"): 60, ("bst", "Asia/Dhaka"): 360, ("est", "Australia/Sydney"): 600, ("est", "Australia/Melbourne"): 600,
    ("edt", "Australia/Sydney"): 660, ("edt", "Australia/Melbourne"): 660, ("cst", "Australia/Adelaide"): 570, ("cdt", "Australia/Adelaide"): 630,
    ("ast", "Asia/Riyadh"): 180, ("pst", "Asia/Manila"): 480,
}
WIDE = "０１２３４５６７８９／：．，－＋　ＴＺ"
NARROW = "0123456789/:.,-+ TZ"


def zone_table_version() -> str:
    """The IANA release that the transition tables are made from, as far as this machine tells."""
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "system"


def stamp_text(col: Column) -> Column:
    """A stamp with full-width characters made narrow, zone words and blanks in one spelling."""
    text = F.translate(col, WIDE, NARROW)
    text = F.regexp_replace(text, r"[\s\x{00a0}\x{202f}\x{2009}]+", " ")
    return F.trim(text)


def shape_of(col: Column) -> Column:
    """A stamp with each run of letters as one class letter; digits and marks stay."""
    return F.regexp_replace(col, r"[A-Za-zÀ-ÿ]+\.?(?:[mM]\.)?|오전|오후|午前|午後|上午|下午", "a")


def mask_of(shape: Column) -> Column:
    """The character-class mask of a shape: 9 for each digit."""
    return F.translate(shape, "012345678", "999999999")


WIDTHS = {"Y": (4,), "M": (1, 2), "D": (1, 2), "?": (1, 2), "h": (1, 2), "m": (2,), "s": (2,), "f": tuple(range(1, 10))}
OFFSETS = (("+99:99", (1, 4)), ("-99:99", (1, 4)), ("+9999", (1, 3)), ("-9999", (1, 3)), ("+99", (1, None)), ("-99", (1, None)))
# Stamps of digit runs only: fields by their first letters in the order of the digits.
RUNS = {"YYYYMMDD": "date", "YYYYMMDDhhmm": "local", "YYYYMMDDhhmmss": "local"}
FIELDS = ("Y", "M", "D", "h", "m", "s", "f", "o", "p")  # o and p: hours and minutes of an offset


def _masks(template: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """All masks of a template with the place (from 1) and width of each field."""
    found: list[tuple[str, list]] = [("", [])]
    skip = 0
    for i, c in enumerate(template):
        if skip:
            skip -= 1
        elif template.startswith("Uhr", i):
            found, skip = [(m + "a", g) for m, g in found], 2
        elif c in WIDTHS:
            found = [(m + "9" * w, [*g, (c, len(m) + 1, w)]) for m, g in found for w in WIDTHS[c]]
        elif c == "o":
            found = [(m + t, [*g, ("o", len(m) + 1 + hours, 2), *([("p", len(m) + 1 + minutes, 2)] if minutes else [])]) for m, g in found for t, (hours, minutes) in OFFSETS]
        elif c in "bwpzZT":
            found = [(m + "a", g) for m, g in found]
        else:
            found = [(m + c, g) for m, g in found]
    return found


@cache
def parser_table() -> list[tuple]:
    """(mask, kind, place and width of each of ``FIELDS``, whether two short numbers need the country's order, what the words tell)."""
    rows: dict[str, tuple] = {}

    def add(mask: str, fields: list[tuple[str, int, int]], kind: str, template: str = "") -> None:
        unsure = [(at, w) for f, at, w in fields if f == "?"]
        place = {f: (at, w) for f, at, w in fields if f != "?"}
        if unsure:
            place |= {"D": unsure[0], "M": unsure[1]}
        flags = (bool(unsure), "b" in template, "p" in template or "Uhr" in template, bool({*template} & {*"zZ"}), "o" in place)
        known = rows.setdefault(mask, (mask, kind, *[x for f in FIELDS for x in place.get(f, (None, None))], *flags))
        # two templates of one mask differ in what their words are: every reading stays open
        rows[mask] = (*known[: -len(flags)], *(a or b for a, b in zip(known[-len(flags) :], flags)))

    def run(digits: str, suffixes: tuple[str, ...], kind: str, gap: str = "") -> None:
        text = digits[:8] + gap + digits[8:]
        fields = [(f, text.index(f) + 1, text.count(f)) for f in FIELDS if f in text]
        for suffix in suffixes:
            for mask, more in _masks(suffix):
                at = len(text)
                add("".join("9" if c in digits else c for c in text) + mask, fields + [(f, at + k, w) for f, k, w in more], kind, suffix)

    for digits, kind in RUNS.items():
        run(digits, ("",) if kind == "date" else ("", "Z"), kind)
        if kind == "local":
            for gap in ("a", " "):
                run(digits, ("", "Z", " z", "o"), kind, gap)
    for n in EPOCH_DIGITS:
        add("9" * n, [], "epoch")
    for t in DATE_TIME_TEMPLATES:
        for suffix in ZONE_SUFFIXES:
            for mask, fields in _masks(t + suffix):
                add(mask, fields, "local", t + suffix)
    for t in DAY_TEMPLATES:
        for mask, fields in _masks(t):
            add(mask, fields, "date", t)
    return list(rows.values())


PARSER_SCHEMA = "mask string, kind string, " + ", ".join(f"{f}_at int, {f}_width int" for f in ("year", "month", "day", "hour", "minute", "second", "fraction", "oh", "om")) + ", unsure boolean, month_word boolean, half_word boolean, has_zone boolean, has_offset boolean"


def _transitions(zone: str) -> list[tuple[datetime, int]]:
    """The zone's (UTC moment, new offset in seconds) over YEARS, the first one at their start."""
    z, step = ZoneInfo(zone), timedelta(days=7)
    offset_at = lambda t: round((z.fromutc(t.replace(tzinfo=z)).replace(tzinfo=None) - t).total_seconds())
    at, end = datetime(YEARS[0] - 1, 12, 30), datetime(YEARS[-1] + 1, 1, 3)
    found = [(at, offset_at(at))]
    while at < end:
        after = at + step
        if offset_at(after) != found[-1][1]:
            low, high = at, after
            while high - low > timedelta(seconds=1):
                middle = low + (high - low) / 2
                middle = middle.replace(microsecond=0)
                if middle in (low, high):
                    break
                low, high = (low, middle) if offset_at(middle) != found[-1][1] else (middle, high)
            found.append((high, offset_at(high)))
        at = after
    return found


def _zone_years(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    epoch = datetime(1970, 1, 1)
    for pdf in batches:
        rows: list[tuple] = []
        for zone in pdf["zone"]:
            try:
                moves = _transitions(zone)
            except Exception:  # noqa: BLE001 - no such zone: its stamps stay without an instant
                continue
            # local second from which an offset holds: in a gap the former offset reads on, in an overlap the first pass holds
            starts = [(int((t - epoch).total_seconds()) + max(before, offset), offset) for (t, offset), before in zip(moves, [moves[0][1], *(o for _, o in moves)])]
            k = 0
            for year in YEARS:
                first = int((datetime(year, 1, 1) - epoch).total_seconds())
                after = int((datetime(year + 1, 1, 1) - epoch).total_seconds())
                while k + 1 < len(starts) and starts[k + 1][0] <= first:
                    k += 1
                inside = [(0, starts[k][1]), *((s - first, o) for s, o in starts if first < s < after)]
                if len(inside) > SLOTS:
                    raise ValueError(f"{zone} moves its clocks {len(inside) - 1} times in {year}")
                inside += [(None, None)] * (SLOTS - len(inside))
                rows.append((zone, year, *(x for step in inside for x in step)))
        yield pd.DataFrame(rows, columns=["zone", "year", *(f"{c}_{k}" for k in range(SLOTS) for c in ("start", "offset"))]).astype({f"{c}_{k}": "Int32" for k in range(SLOTS) for c in ("start", "offset")})


def zone_table(spark: SparkSession, zones: DataFrame) -> DataFrame:
    """(zone, year, start_0, offset_0, ...) for the IANA zones in column ``zone``: the local second of the year from which each offset holds."""
    ship_package(spark)
    schema = "zone string, year int, " + ", ".join(f"start_{k} int, offset_{k} int" for k in range(SLOTS))
    return zones.select("zone").where(F.col("zone").rlike(r"^[A-Z][A-Za-z]+(/[A-Za-z0-9_+\-]+)*$")).distinct().mapInPandas(_zone_years, schema)


def table_year(year: Column) -> Column:
    """The year of the zone table that a year is read by: before the table its first year (local mean time), after it the
    year of its last 28 that begins on the same weekday and has as many days, as rules of zones go by weekdays."""
    like = {datetime(y, 1, 1).isoweekday() % 7 * 2 + calendar.isleap(y): y for y in range(YEARS[-1] - 27, YEARS[-1] + 1)}
    leap = ((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))).cast("int")
    later = _word_table(like)[(F.dayofweek(F.make_date(year, F.lit(1), F.lit(1))) - 1) * 2 + leap]
    return F.when(year < YEARS[0], YEARS[0]).when(year > YEARS[-1], later).otherwise(year)


def _word_table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _zone_offset(second: Column) -> Column:
    """The offset in seconds that holds at a local second of the year, from the slots of a zone's row."""
    held = F.col("offset_0")
    for k in range(1, SLOTS):
        held = F.when(second >= F.col(f"start_{k}"), F.col(f"offset_{k}")).otherwise(held)
    return held


def _midnight_offset(micros: Column, year_start: Column) -> Column:
    """The offset that makes an instant exactly a midnight of the zone; null if none that holds then does."""
    found = F.lit(None).cast("int")
    for k in range(SLOTS):
        local = F.col(f"offset_{k}").cast("long") * 1_000_000 + micros
        holds = F.pmod(local, F.lit(86_400_000_000)) == 0
        second = local / 1_000_000 - year_start
        if k:
            holds &= second >= F.col(f"start_{k}")
        if k + 1 < SLOTS:
            holds &= F.coalesce(second < F.col(f"start_{k + 1}"), F.lit(True))
        found = F.when(holds, F.col(f"offset_{k}")).otherwise(found)
    return found


def normalise_stamps(rows: DataFrame, sources: DataFrame, stamp: str = "stamp_raw", note: str | None = "zone_note", field: str | None = "stamp_field", day_numbers: tuple[str, ...] = ("announcementTime",)) -> DataFrame:
    """``rows`` with ``instant_us`` (UTC microseconds since 1970, null unless the stamp is an instant) and ``plain_day``.

    The stamp's own zone or offset holds first, then ``note`` (an offset, an IANA name or an abbreviation), then the
    source's ``civil_zone``. Abbreviations mean what they mean in the country of the source's zone. Two short numbers
    before a year are month and day for American zones, day and month elsewhere; a number above 12 settles it.
    Stamps of day precision give ``plain_day`` only; so do epoch numbers of the fields ``day_numbers`` that are exactly
    midnight of the source's zone. Null, empty, placeholder and unreadable stamps, impossible dates and unknown sources
    without a zone give null in both. A local time that occurs twice is read as the first one; one that is skipped is
    read with the offset before the gap. Fractions of a second are kept to the microsecond. Years from 1 to 9999 are read,
    see ``table_year``. Rows are never dropped or repeated; columns named like the two results are replaced.
    """
    spark = rows.sparkSession
    keep_methods_compiled(spark)
    kept = [c for c in rows.columns if c not in ("instant_us", "plain_day")]
    zones = sources.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.min("civil_zone").alias("__civil"))
    note_text = F.nullif(F.trim(F.col(note)), F.lit("")) if note else F.lit(None).cast("string")
    work = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"),
        F.col("source_id").alias("source_id"),
        stamp_text(F.col(stamp)).alias("__s"),
        note_text.alias("__note"),
        (F.coalesce(F.col(field).isin(*day_numbers), F.lit(False)) if field else F.lit(False)).alias("__day_number"),
    )
    work = work.join(zones, "source_id", "left").drop("source_id").withColumn("__shape", shape_of(F.col("__s")))
    parsers = spark.createDataFrame(parser_table(), PARSER_SCHEMA)
    # the table is made from the templates above, a few thousand short rows whatever the data
    work = work.withColumn("mask", mask_of(F.col("__shape"))).join(F.broadcast(parsers), "mask", "left").drop("mask")

    def number(name: str) -> Column:
        return F.col("__shape").substr(F.col(f"{name}_at"), F.col(f"{name}_width")).cast("int")

    low = F.lower(F.col("__s"))
    month_name = F.regexp_extract(low, "(?:^|[^a-zà-ÿ])(" + "|".join(MONTHS) + ")", 1)
    last_word = F.regexp_extract(low, r"([a-z]+)\)?$", 1)
    half = [F.lit(False)] * 2
    for k, words in enumerate((AFTERNOON, MORNING)):
        for w in words:
            half[k] = half[k] | F.contains(low, F.lit(w))
    # the last word may be a zone, a day half or the German for o'clock under one mask
    fraction = F.rpad(F.col("__shape").substr(F.col("fraction_at"), F.least("fraction_width", F.lit(6))), 6, "0").cast("int")
    sign = F.when(F.col("__shape").substr(F.col("oh_at") - 1, F.lit(1)) == "-", -1).otherwise(1)
    work = work.select(
        "__row", "__civil", "__note", "__day_number", "kind", "unsure",
        *[number(c).alias(c) for c in ("year", "hour", "minute", "second")],
        F.when(F.col("month_word"), _word_table(MONTHS)[month_name]).otherwise(number("month")).alias("month"), number("day").alias("day"),
        F.when(F.col("half_word"), F.when(half[0], 12).when(half[1], 0)).alias("half"), fraction.alias("fraction"),
        F.when(F.col("has_offset"), sign * (number("oh") * 60 + F.coalesce(number("om"), F.lit(0)))).alias("own"),
        F.when(F.col("has_zone"), F.when(~last_word.isin("am", "pm", "m", "uhr", ""), last_word)).alias("word"),
        F.when(F.col("kind") == "epoch", F.col("__s").cast("decimal(19,0)")).alias("number"), F.length("__s").alias("n_digits"),
    )

    american = F.coalesce(F.col("__civil").startswith("America/"), F.lit(False))
    swapped = F.col("unsure") & ((american & (F.col("day") <= 12)) | (F.col("month") > 12))
    micros = F.lit(None).cast("bigint")
    for n, power in EPOCH_DIGITS.items():
        scaled = F.col("number") * 10 ** (6 - power) if power <= 6 else F.floor(F.col("number") / 10 ** (power - 6))
        micros = F.when(F.col("n_digits") == n, scaled.cast("bigint")).otherwise(micros)
    hour = F.when((F.col("half") == 12) & (F.col("hour") < 12), F.col("hour") + 12).when((F.col("half") == 0) & (F.col("hour") == 12), 0).otherwise(F.col("hour"))
    work = work.select(
        "__row", "__civil", "__note", "__day_number", "kind", "year", "minute", "second", "fraction", "own", "word",
        F.when(swapped, F.col("day")).otherwise(F.col("month")).alias("month"), F.when(swapped, F.col("month")).otherwise(F.col("day")).alias("day"),
        hour.alias("hour"), F.when(F.col("kind") == "epoch", micros).alias("micros"),
    )

    month_start = F.when((F.col("year") >= 1) & F.col("month").between(1, 12), F.make_date("year", "month", F.lit(1)))
    work = work.withColumn("month_start", month_start)
    the_day = F.when((F.col("day") >= 1) & (F.col("day") <= F.dayofmonth(F.last_day("month_start"))), F.date_add("month_start", F.col("day") - 1))
    clock_ok = F.col("hour").between(0, 23) & F.col("minute").between(0, 59) & F.coalesce(F.col("second") <= 60, F.lit(True))
    clock = F.when(clock_ok & (F.col("kind") == "local"), F.col("hour") * 3600 + F.col("minute") * 60 + F.coalesce("second", F.lit(0)))

    note_low = F.lower(F.col("__note"))
    note_offset = r"^(?:utc|gmt)?\s*([+\-])([0-9]{1,2}):?([0-9]{2})?$"
    note_minutes = F.when(F.regexp_extract(note_low, note_offset, 1) == "-", -1).otherwise(1) * (
        F.regexp_extract(note_low, note_offset, 2).cast("int") * 60 + F.coalesce(F.nullif(F.regexp_extract(note_low, note_offset, 3), F.lit("")).cast("int"), F.lit(0))
    )
    by_country = _word_table({f"{word} {zone}": v for (word, zone), v in ABBREVIATIONS_OF.items()})
    common = _word_table(ABBREVIATIONS)

    def meaning(word: Column) -> Column:
        return F.coalesce(by_country[F.concat_ws(" ", word, F.col("__civil"))], common[word])

    noted = F.when(note_low.rlike(note_offset), note_minutes).when(note_low.rlike("^[a-z]+$"), meaning(note_low))
    # the offset: the stamp's own, else the note's; a word of the stamp that means nothing leaves it open
    offset = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("word").isNotNull(), meaning(F.col("word"))).when(F.col("__note").isNotNull(), noted)
    work = work.select("__row", "__civil", "__note", "__day_number", "kind", "micros", "fraction", "word", the_day.alias("the_day"), clock.alias("clock"), offset.alias("offset"))
    # the named zone: of a local time without offset, or the source's for a number that may be a midnight
    epoch_day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("micros") / 86_400_000_000).cast("int"))
    number_day = F.when((F.col("kind") == "epoch") & F.col("__day_number"), epoch_day)
    named = F.when(F.col("__note").contains("/"), F.col("__note")).otherwise(F.col("__civil"))
    work = work.select(
        "__row", "kind", "micros", "fraction", "the_day", "clock", "offset",
        F.coalesce(number_day, F.when(F.col("clock").isNotNull(), F.col("the_day"))).alias("anchor"),
        F.when(number_day.isNotNull(), F.col("__civil")).when(F.col("offset").isNull() & F.col("word").isNull() & F.col("clock").isNotNull(), named).alias("zone"),
    )

    zone_names = zones.select(F.col("__civil").alias("zone"))
    if note:
        zone_names = zone_names.unionByName(rows.select(note_text.alias("zone")).where(F.col("zone").contains("/")).distinct())
    # at most the IANA names, some 600, times the years of the table
    steps = F.broadcast(zone_table(spark, zone_names).withColumnRenamed("year", "__year"))
    work = work.withColumn("__year", table_year(F.year("anchor"))).join(steps, ["zone", "__year"], "left")
    year_second = (F.dayofyear("the_day") - 1) * 86400 + F.col("clock")
    year_start = F.unix_date("anchor").cast("long") * 86400 - (F.dayofyear("anchor") - 1) * 86400
    work = work.withColumn("shift", F.coalesce(F.col("offset") * 60, F.when(F.col("clock").isNotNull(), _zone_offset(year_second))))
    work = work.withColumn("midnight", F.when((F.col("kind") == "epoch") & F.col("zone").isNotNull(), _midnight_offset(F.col("micros"), year_start)))
    local = F.unix_date("the_day").cast("long") * 86400 + F.col("clock")
    instant = F.when(F.col("kind") == "epoch", F.when(F.col("midnight").isNull(), F.col("micros"))).otherwise((local - F.col("shift")) * 1_000_000 + F.coalesce("fraction", F.lit(0)))
    midnight_day = F.date_add(F.lit("1970-01-01").cast("date"), ((F.col("micros") + F.col("midnight").cast("long") * 1_000_000) / 86_400_000_000).cast("int"))
    return work.select(
        *[F.col("__row")[c].alias(c) for c in kept],
        instant.alias("instant_us"),
        F.when(F.col("midnight").isNotNull(), midnight_day).when(F.col("kind") == "date", F.col("the_day")).alias("plain_day"),
    )


def same_minute_pairs(stamped: DataFrame, group: str = "filing_no", row_id: str = "row_id") -> DataFrame:
    """(row_id_a, row_id_b), smaller first: rows of one ``group`` whose instants fall in the same UTC minute.

    Rows without group, id or instant are in no pair; a row id that occurs twice pairs with others once. Both sides of the
    join read one exchange on (group, minute), so a hot group is spread by its minutes and split further by AQE.
    """
    slim = stamped.where(F.col("instant_us").isNotNull() & F.col(group).isNotNull() & F.col(row_id).isNotNull()).select(
        F.col(group).alias("g"), F.floor(F.col("instant_us") / 60_000_000).alias("minute"), F.col(row_id).alias("row_id")
    )
    slim = slim.repartition("g", "minute")
    a, b = slim.alias("a"), slim.alias("b")
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.minute") == F.col("b.minute")) & (F.col("a.row_id") < F.col("b.row_id")))
    return pairs.select(F.col("a.row_id").alias("row_id_a"), F.col("b.row_id").alias("row_id_b")).distinct()
