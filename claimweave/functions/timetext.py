"""Reading dates and clock times out of free text, as column expressions only.

One regular expression splits a value into date, time and zone pieces; everything
after that is integer arithmetic on microseconds, so the session time zone never
matters and the whole reading stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and their usual abbreviations in en, de, fr, es.
MONTHS = {
    1: "jan january januar jänner janvier janv enero ene",
    2: "feb february februar février févr fevrier febrero",
    3: "mar march märz mrz mars marzo",
    4: "apr april avril avr abril abr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet juil julio",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre septiembre setiembre",
    10: "oct october oktober okt octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dezember dez décembre déc decembre diciembre dic",
}
# Abbreviations that say which of two readings of a repeated hour is meant.
DAYLIGHT = "AEDT ACDT NZDT NDT ADT EDT CDT MDT PDT BST WEST CEST EEST".split()
STANDARD = "AEST ACST AWST NZST NST AST EST CST MST PST WET CET EET".split()

DAY_US = 86_400_000_000
_SEP = "\u0001"
_DATE = (
    r"(?:(\d{4})([-/])(\d{1,2})\2(\d{1,2})"  # 1 y, 3 m, 4 d
    r"|(\d{4})(\d{2})(\d{2})(?=[Tt ]|$)"  # 5 y, 6 m, 7 d
    r"|(\d{1,2})([-/])(\d{1,2})\9(\d{4})"  # 8 a, 10 b, 11 y
    r"|(\d{1,2})\.(\d{1,2})\.(\d{4})"  # 12 d, 13 m, 14 y
    r"|(\d{1,2})(?:st|nd|rd|th|er|\.)?(?:\s+de|\s+of)?[\s-]+(\p{L}+)\.?(?:\s+de|\s+del)?,?[\s-]+(\d{4})"  # 15 d, 16 mon, 17 y
    r"|(\p{L}+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}))"  # 18 mon, 19 d, 20 y
)
_TIME = r"(?:[Tt]|,?\s+)(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"  # 21 h, 22 mi, 23 s, 24 frac, 25 half
_ZONE = (
    r"\s*(?:(Z|z|UTC|GMT)|([+-]\d{2}:?\d{0,2})?\s*(?:[\[(]?([A-Z][A-Za-z]+(?:/[A-Za-z_+-]+)+)[\])]?)?"  # 26 utc, 27 offset, 28 name
    r"|([A-Z]{2,5}))"  # 29 abbreviation
)
FULL = r"(?iu)^(?-i:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?" + _DATE + r"(?-i:" + _TIME + _ZONE + r")?$"
_PARTIAL = r"(?iu)^(?:(\d{4})-(\d{2})|(\p{L}+)\.?,?(?:\s+de|\s+del)?\s+(\d{4})|(\d{4}))$"


def _pieces(value: Column, pattern: str, groups: int) -> Column:
    """All groups of a whole-value match as an array (empty texts for absent groups), null if it doesn't match."""
    marked = F.regexp_replace(value, pattern, _SEP + _SEP.join(f"${i}" for i in range(1, groups + 1)))
    return F.when(marked.startswith(_SEP), F.split(marked, _SEP))


def month_number(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(None).cast("int")
    for number, words in MONTHS.items():
        out = F.when(low.isin(words.split()), F.lit(number)).otherwise(out)
    return out


def _int(x: Column) -> Column:
    return F.when(x != "", x).cast("int")


def days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return (
        F.when(month.isin(1, 3, 5, 7, 8, 10, 12), 31)
        .when(month.isin(4, 6, 9, 11), 30)
        .when(month == 2, F.when(leap, 29).otherwise(28))
    )


def _pad(x: Column, width: int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def iso_date(y: Column, m: Column, d: Column) -> Column:
    return F.concat(_pad(y, 4), F.lit("-"), _pad(m, 2), F.lit("-"), _pad(d, 2))


def instant_text(us: Column) -> Column:
    """Microseconds since 1970 as ``YYYY-MM-DDTHH:MM:SS.ffffffZ``."""
    day = ((us - F.pmod(us, F.lit(DAY_US))) / F.lit(DAY_US)).cast("int")
    rest = F.pmod(us, F.lit(DAY_US))
    sec = ((rest - rest % 1_000_000) / 1_000_000).cast("int")
    hour, minute = ((sec - sec % 3600) / 3600).cast("int"), ((sec % 3600 - sec % 60) / 60).cast("int")
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"), _pad(hour, 2), F.lit(":"), _pad(minute, 2), F.lit(":"),
        _pad(sec % 60, 2), F.lit("."), _pad(rest % 1_000_000, 6), F.lit("Z"),
    )


def fence(df: DataFrame, keep: list[str], *cols: Column) -> DataFrame:
    """Columns ``keep`` plus computed ones behind a one-row generator.

    A filter above stops here instead of being pushed down with every expression
    written out in place of its column, which grows exponentially over steps.
    """
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline_outer(F.array(F.struct(*cols))))


def read_value(df: DataFrame, value: Column, order: Column, keep: list[str]) -> DataFrame:
    """What each text says by itself, as extra columns, one narrow projection after another.

    ``_plain``: final text of a value without clock time, or null. ``_at``: instant in
    microseconds where the value fixes it (offset, UTC, Unix time), else null.
    ``_local``: wall-clock microseconds, null without clock time. ``_zone``: named zone
    in the value. ``_abbr``: zone abbreviation. Steps are separate projections of plain
    columns so that no step's expression is copied into the next.
    """
    held = [F.col(f"`{c}`") for c in keep]
    s1 = df.select(*held, F.trim(F.regexp_replace(value, r"\s+", " ")).alias("_v"), F.lower(order).alias("_o"))
    s2 = s1.select(*held, "_v", "_o", _pieces(F.col("_v"), FULL, 29).alias("_p"), _pieces(F.col("_v"), _PARTIAL, 5).alias("_q"))
    o = F.col("_o")
    p = lambda i: F.get("_p", F.lit(i))
    q = lambda i: F.get("_q", F.lit(i))
    a, b = _int(p(8)), _int(p(10))
    name = F.when(p(16) != "", p(16)).when(p(18) != "", p(18)).when(q(3) != "", q(3))
    s3 = s2.select(
        *held, "_v", "_o", "_p", "_q", month_number(name).alias("_mon"),
        F.coalesce(*[_int(p(i)) for i in (1, 5, 11, 14, 17, 20)]).alias("_y"),
        F.coalesce(_int(p(3)), _int(p(6)), F.when(o == "dmy", b).when(o == "mdy", a), _int(p(13))).alias("_m0"),
        F.coalesce(
            _int(p(4)), _int(p(7)), F.when(o == "dmy", a).when(o == "mdy", b), *[_int(p(i)) for i in (12, 15, 19)]
        ).alias("_d"),
        _int(p(21)).alias("_h"), _int(p(22)).alias("_mi"), F.coalesce(_int(p(23)), F.lit(0)).alias("_s"),
        F.when(p(24) != "", F.rpad(F.substring(p(24), 1, 6), 6, "0").cast("int")).otherwise(0).alias("_us"),
        F.lower(p(25)).alias("_half"), F.regexp_replace(p(27), ":", "").alias("_off"),
    )
    y, m, d, h = F.col("_y"), F.coalesce("_m0", "_mon"), F.col("_d"), F.col("_h")
    in_calendar = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= days_in_month(y, m))
    hour = (
        F.when(F.col("_half") == "", F.when(h <= 23, h))
        .when(h.between(1, 12), F.pmod(h, F.lit(12)) + F.when(F.col("_half") == "p", 12).otherwise(0))
    )
    off_h = _int(F.substring("_off", 2, 2))
    off_m = F.coalesce(_int(F.substring("_off", 4, 2)), F.lit(0))
    s4 = s3.select(
        *held, "_v", "_p", "_q", "_mon", F.when(in_calendar, iso_date(y, m, d)).alias("_iso"),
        F.when(
            (F.col("_mi") <= 59) & (F.col("_s") <= 59),
            (hour.cast("long") * 3600 + F.col("_mi") * 60 + F.col("_s")) * 1_000_000 + F.col("_us"),
        ).alias("_clock"),
        F.when(
            (F.col("_off") != "") & (off_h <= 18) & (off_m <= 59),
            F.when(F.col("_off").startswith("-"), -1).otherwise(1) * (off_h * 60 + off_m).cast("long") * 60_000_000,
        ).alias("_shift"),
    )
    week = r"^(\d{4})-?[Ww](\d{2})-?([1-7])$"
    wy, ww, wd = (F.regexp_extract("_v", week, i).cast("int") for i in (1, 2, 3))
    jan4 = F.make_date(F.when(F.col("_v").rlike(week) & wy.between(1, 9999), wy), F.lit(1), F.lit(4))
    week_day = F.date_add(F.date_sub(jan4, F.weekday(jan4)), (ww - 1) * 7 + wd - 1)
    qm, qy = F.coalesce(_int(q(2)), F.col("_mon")), F.coalesce(*[_int(q(i)) for i in (1, 4, 5)])
    timed = p(21) != ""
    s5 = s4.select(
        *held, "_v", "_p", "_shift",
        F.when(timed, F.unix_date(F.col("_iso").cast("date")).cast("long") * DAY_US + F.col("_clock")).alias("_wall"),
        F.when(F.col("_iso").isNotNull() & ~timed, F.col("_iso"))
        .when(F.weekofyear(week_day) == ww, week_day.cast("string"))
        .when(qy.between(1, 9999) & (q(5) != ""), _pad(qy, 4))
        .when(qy.between(1, 9999) & qm.between(1, 12), F.concat(_pad(qy, 4), F.lit("-"), _pad(qm, 2)))
        .alias("_plain"),
    )
    fixed = (p(26) != "") | (p(27) != "")
    v, wall = F.col("_v"), F.col("_wall")
    return fence(
        s5, keep, F.col("_plain").alias("_plain"),
        F.when(v.rlike(r"^\d{10}$"), v.cast("long") * 1_000_000)
        .when(v.rlike(r"^\d{10}[.]\d{1,6}$"), F.substring(v, 1, 10).cast("long") * 1_000_000 + F.rpad(F.substring(v, 12, 6), 6, "0").cast("long"))
        .when(v.rlike(r"^\d{13}$"), v.cast("long") * 1_000)
        .when(p(26) != "", wall).when(p(27) != "", wall - F.col("_shift")).alias("_at"),
        F.when(~fixed, wall).alias("_local"),
        F.when(~fixed & (p(28) != ""), p(28)).alias("_zone"),
        F.when(~fixed & (p(29) != ""), p(29)).alias("_abbr"),
    )


def known_zones(spark: SparkSession) -> list[str]:
    """Names that the JVM's time-zone database has; some six hundred, whatever the data."""
    return sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if not z.startswith("SystemV/"))


def zone_name(zone: Column, zones: list[str]) -> Column:
    """A declared zone in the form the engine takes: a database name, or a fixed offset as ``+HH:MM``; null if it is neither."""
    bare = F.trim(zone)
    offset = r"^(?:UTC|GMT|utc|gmt)?\s*([+-])(\d{1,2}):?(\d{2})?$"
    part = lambda i: F.regexp_extract(bare, offset, i)
    hour, minute = part(2).cast("int"), F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
    fixed = F.concat(part(1), _pad(hour, 2), F.lit(":"), _pad(minute, 2))
    return (
        F.when(bare.isin(zones), bare)
        .when(F.upper(bare).isin("UTC", "GMT", "Z", "ZULU"), "UTC")
        .when(bare.rlike(offset) & (hour * 60 + minute <= 18 * 60) & (minute <= 59), fixed)
    )


def wall_to_utc(df: DataFrame, local: str, zone: str, abbr: str, out: str) -> DataFrame:
    """Adds ``out``: the instant of a wall-clock reading in a zone, null if it occurs twice or never there.

    A daylight or standard abbreviation decides between the two instants of a
    repeated hour. Works for changes of any length: the second candidate uses the
    offset in force a day later.
    """
    to_utc = lambda x: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(x), F.col(zone)))
    from_utc = lambda x: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(x), F.col(zone)))
    keep = df.columns
    s1 = fence(df, keep, to_utc(F.col(local)).alias("_first"))
    later = F.col("_first") + DAY_US
    s2 = fence(s1, [*keep, "_first"], (F.col(local) - (from_utc(later) - later)).alias("_second"))
    first, second = F.col("_first"), F.col("_second")
    twice = (second != first) & (from_utc(second) == F.col(local))
    placed = (
        F.when(from_utc(first) != F.col(local), F.lit(None).cast("long"))
        .when(twice, F.when(F.col(abbr).isin(DAYLIGHT), first).when(F.col(abbr).isin(STANDARD), second))
        .otherwise(first)
    )
    return fence(s2, keep, placed.alias(out))


def earliest_instant(df: DataFrame, local: str, zone: str, out: str) -> DataFrame:
    """Adds ``out``: the first instant at which a wall clock in the zone shows the reading, null if it never does."""
    fenced = fence(df, df.columns, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col(local)), F.col(zone))).alias("_t"))
    shown = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.col("_t")), F.col(zone)))
    return fence(fenced, df.columns, F.when(shown == F.col(local), F.col("_t")).alias(out))
