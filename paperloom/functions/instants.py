"""Dates as they stand on a page, as one instant in UTC.

The cascade: white space is normalised; an anchored pattern splits the value into date part, clock time and zone;
the date part runs through an ordered list of anchored patterns, of which the first that names an existing day wins;
the zone in the value holds, else the row's default zone if it is one this session knows, else UTC. Everything is a
built-in expression, so the cascade runs inside the scan's stage.

Policy: a local time that occurs twice is the earlier instant, a skipped one moves on by the length of the gap (both
as `to_utc_timestamp` has it); digits finer than microseconds are cut off; without a time the day's start counts.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and abbreviations in English, German, French and Spanish, without accents, by month.
MONTHS = [
    "january jan januar jan janvier janv enero ene jaenner janner",
    "february feb februar feb fevrier fevr fev febrero feb feber",
    "march mar marz maerz mrz mars marzo",
    "april apr avril avr abril abr",
    "may mai mayo",
    "june jun juni juin junio",
    "july jul juli juillet juil julio",
    "august aug aout agosto ago",
    "september sep sept septembre septiembre set setiembre",
    "october oct oktober okt octobre octubre",
    "november nov novembre noviembre",
    "december dec dezember dez decembre diciembre dic",
]
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lun mar mer jeu ven sam dim "
    "lunes martes miercoles jueves viernes sabado domingo mie jue vie sab dom"
)
# Minutes east of UTC of zone abbreviations; BST, CST and EST as TESTDATA.md defines them.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150,
}
MONTH_FIRST_LOCALES = ("en-US",)

_OFFSET = r"(?:(?:UTC|GMT)? ?[+\-−](?:0?\d|1[0-4])(?::?[0-5]\d)?)"
_REGION = r"(?:[A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+\-]+){1,2})"
_ZONE = rf"(\[?(?:{_OFFSET}|{_REGION}|[A-Za-z]{{1,5}})\]?|{_OFFSET} ?\[{_REGION}\])"
#: date, hour, minute, second, fraction, half of the day, zone
_TIMED = rf"^(.*?\d\.?)(?:[Tt]|,? |, ?|,? (?:at|um|à|a las) )(\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?: Uhr)? ?([AaPp]\.?[Mm]\.?)? ?{_ZONE}?$"
_COMPACT = rf"^(\d{{8}})[Tt]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?()? ?{_ZONE}?$"
#: a day with a zone and no time: only zones that can't be part of the date itself
_ZONED_DAY = rf"^(.*?\d\.?) ?(Z|UTC|GMT|[+\-−]\d{{2}}:\d{{2}}|\[?{_REGION}\]?)$"


def _plain(text: Column) -> Column:
    """Lower case, without accents."""
    return F.translate(F.lower(text), "áàâäãéèêëíìîïóòôöõúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")


def _number(text: Column) -> Column:
    """The digits as INT; null for other texts."""
    return text.try_cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970, null where there is no such day."""
    zero = F.lit(0)
    at = F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("double"))
    return F.when((year >= 1) & (year <= 9999) & (month > 0) & (day > 0), F.unix_date(at.cast("date")))


def _month_number(name: Column) -> Column:
    names = {n: i + 1 for i, row in enumerate(MONTHS) for n in row.split()}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(_number(name), F.try_element_at(table, name))


def _monday_of_week_1(year: Column) -> Column:
    jan4 = _day(year, F.lit(1), F.lit(4))
    return jan4 - F.pmod(jan4 + 3, F.lit(7))


def _weekday_pattern() -> str:
    """A leading weekday. A short one needs a comma, or a day and a month's name after it: "Mar 27, 2022" is March."""
    words = sorted(set(WEEKDAYS.split()), key=lambda w: (-len(w), w))
    full = "|".join(w for w in words if len(w) > 5)
    return rf"^(?:(?:{full}),? ?|(?:{'|'.join(words)})\.?, ?|(?:{'|'.join(words)})\.? (?=\d{{1,2}}\.? (?:de )?[a-z]))(?:(?:the|den|le|el) )?"


#: The ordered cascade over a date in lower case without accents and weekday: an anchored pattern, and how its groups
#: give year, month and day. Kind "slash": the locale decides which of month and day comes first; "week", "ordinal":
#: ISO week and day, day of the year.
CASCADE = [
    ("day", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1 $2 $3"),
    ("day", r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1 $2 $3"),
    ("day", r"^(\d{4})\.(\d{1,2})\.(\d{1,2})\.?$", "$1 $2 $3"),
    ("day", r"^(\d{4})(\d{2})(\d{2})$", "$1 $2 $3"),
    ("slash", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3 $1 $2"),
    ("slash", r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "20$3 $1 $2"),
    ("day", r"^(\d{1,2})\. ?(\d{1,2})\. ?(\d{4})$", "$3 $2 $1"),
    ("day", r"^(\d{1,2})\. ?(\d{1,2})\. ?(\d{2})$", "20$3 $2 $1"),
    ("day", r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3 $2 $1"),
    ("day", r"^(\d{1,2})-(\d{1,2})-(\d{2})$", "20$3 $2 $1"),
    ("week", r"^(\d{4})-?w(\d{2})-?(\d)$", "$1 $2 $3"),
    ("ordinal", r"^(\d{4})-(\d{3})$", "$1 $2 0"),
    ("day", r"^(\d{1,2})(?:st|nd|rd|th|er|\.|º|o)? ?(?:of |de |-|/|\.)?([a-z]+)\.?(?:,? (?:de |del )?|-|/)(\d{4})$", "$3 $2 $1"),
    ("day", r"^(\d{1,2})(?:st|nd|rd|th|er|\.|º|o)? ?(?:of |de |-|/|\.)?([a-z]+)\.?(?:,? (?:de |del )?|-|/)(\d{2})$", "20$3 $2 $1"),
    ("day", r"^([a-z]+)\.? (?:the )?(\d{1,2})(?:st|nd|rd|th|\.)?,? ?(\d{4})$", "$3 $1 $2"),
    ("day", r"^([a-z]+)-(\d{1,2})-(\d{4})$", "$3 $1 $2"),
    ("day", r"^(\d{4})[ \-/.]([a-z]+)[ \-/.](\d{1,2})$", "$1 $2 $3"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: without it every mention would repeat the whole expression."""
    return F.transform(F.array(value), body)[0]


def day_number(date: Column, locale: Column) -> Column:
    """Days since 1970 of a date without a time, by the cascade; null for all that names no existing day."""
    month_first = locale.isNull() | locale.isin(*MONTH_FIRST_LOCALES)

    def day(p: Column) -> Column:
        kind, y, a, b = p["kind"], p["y"], p["a"], p["b"]
        slash = F.when(month_first, F.coalesce(_day(y, a, b), _day(y, b, a))).otherwise(F.coalesce(_day(y, b, a), _day(y, a, b)))
        in_week = _monday_of_week_1(y) + (a - 1) * 7 + (b - 1)
        week = F.when((a >= 1) & (b >= 1) & (b <= 7) & (in_week < _monday_of_week_1(y + 1)), in_week)
        of_year = _day(y, F.lit(1), F.lit(1)) + a - 1
        ordinal = F.when((a >= 1) & (of_year < _day(y + 1, F.lit(1), F.lit(1))), of_year)
        return F.when(kind == "slash", slash).when(kind == "week", week).when(kind == "ordinal", ordinal).when(kind == "day", _day(y, a, b))

    def parts(text: Column) -> Column:
        hits = [F.when(text.rlike(p), F.concat(F.lit(kind + " "), F.regexp_replace(text, p, to))) for kind, p, to in CASCADE]
        return let(F.split(F.coalesce(*hits), " "), lambda x: F.struct(x[0].alias("kind"), _number(x[1]).alias("y"), _month_number(x[2]).alias("a"), _number(x[3]).alias("b")))

    return let(let(F.regexp_replace(_plain(date), _weekday_pattern(), ""), parts), day)


def _offset_us(zone: Column) -> Column:
    """Microseconds east of UTC of an offset or abbreviation; null for other zones."""
    shape = r"^\[?(?:UTC|GMT)? ?([+\-−])(\d{1,2}):?(\d{2})?\]?(?: ?\[.*\])?$"
    part = F.split(F.regexp_replace(zone, shape, "$1 $2 0$3"), " ")
    minutes = _number(part[1]) * 60 + _number(part[2])
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    named = F.try_element_at(table, F.upper(F.regexp_replace(zone, r"[\[\]]", "")))
    return F.when(zone.rlike(shape), F.when(part[0] == "+", minutes).otherwise(-minutes)).otherwise(named).cast("long") * 60_000_000


def known_zones(spark: SparkSession) -> list[str]:
    """IANA zone names that the engine converts (about 600; a fixed list of the runtime)."""
    try:
        ids = set(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:  # a session without a driver's JVM
        ids = set(zoneinfo.available_timezones())
    return sorted(z for z in ids if "/" in z or z in ("UTC", "GMT"))


def epoch_us(value: Column, locale: Column, default_zone: Column, zones: list[str]) -> Column:
    """Microseconds since 1970-01-01 UTC of a value that names one existing day or counts seconds or milliseconds
    since then.

    Null, blank, partial (months, years, quarters), worded and impossible values give null. The default zone applies
    where the value has none; a default that is null or not among `zones` (see `known_zones`) counts as UTC.
    """
    known = F.array(*[F.lit(z) for z in zones])
    own = F.trim(default_zone)

    def split(s: Column, pattern: str, to: list[str]) -> Column:
        return F.when(s.rlike(pattern), F.split(F.regexp_replace(s, pattern, "\u0001".join(to)), "\u0001"))

    def parts(s: Column) -> Column:
        """date, hour, minute, second, fraction, half of the day, zone, the whole value"""
        groups = [f"${i}" for i in range(1, 8)] + ["$0"]
        day_only = split(s, _ZONED_DAY, ["$1", "", "", "", "", "", "$2", "$0"])
        return F.coalesce(split(s, _COMPACT, groups), split(s, _TIMED, groups), day_only, F.array(s, *[F.lit("")] * 6, s))

    def clock(part: Column) -> Column:
        half, h = F.lower(F.substring(part[5], 1, 1)), _number(part[1])
        hour = F.when(half == "p", F.when(h <= 12, h % 12 + 12)).when(half == "a", F.when(h <= 12, h % 12)).otherwise(h)
        second = F.when(part[3] == "", 0).otherwise(_number(part[3]))
        micros = F.when(part[4] == "", 0).otherwise(_number(F.rpad(F.substring(part[4], 1, 6), 6, "0")))
        fields = F.struct(hour.alias("h"), _number(part[2]).alias("m"), second.alias("s"), micros.alias("us"))
        ok = lambda t: (t["h"] < 24) & (t["m"] < 60) & (t["s"] < 60)
        at = let(fields, lambda t: F.when(ok(t), ((t["h"] * 60 + t["m"]) * 60 + t["s"]).cast("long") * 1_000_000 + t["us"]))
        return F.when(part[1] != "", at).otherwise(F.lit(0))

    def placed(t: Column) -> Column:
        """A local time in its zone: an offset, a region of the value, the default zone."""
        region = F.when(t["named"] != "", F.when(F.array_contains(known, t["named"]), t["named"])).otherwise(
            F.when(F.array_contains(known, own), own).otherwise(F.lit("UTC"))
        )
        in_region = F.when((t["zone"] == "") | (t["named"] != ""), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(t["local"]), region)))
        return F.coalesce(t["local"] - t["offset"], in_region)

    def dated(part: Column) -> Column:
        local = day_number(F.regexp_replace(part[0], r"[, ]+$", ""), locale).cast("long") * 86_400_000_000 + clock(part)
        time = F.struct(local.alias("local"), part[6].alias("zone"), F.regexp_extract(part[6], _REGION, 0).alias("named"), _offset_us(part[6]).alias("offset"))
        return let(time, placed)

    def counted(s: Column) -> Column:
        n = s.try_cast("decimal(20,6)")
        return F.when(s.rlike(r"^\d{9,10}(\.\d+)?$"), (n * 1_000_000).cast("long")).when(s.rlike(r"^\d{12,13}(\.\d+)?$"), (n * 1_000).cast("long"))

    cleaned = F.trim(F.regexp_replace(value, r"[\s\u00a0\u2000-\u200b\u202f\u3000]+", " "))
    return let(cleaned, lambda s: F.coalesce(counted(s), let(parts(s), dated)))


def normalise(df: DataFrame, key: str, columns: list[str], locale: str = "doc_locale", zone: str = "time_zone") -> DataFrame:
    """row_key, field_name, value, epoch_us: each value of `columns` that is a case (see `epoch_us`), once however often
    its row was sent. Null keys are kept as one key; other columns are not read.
    """
    zones = known_zones(df.sparkSession)
    pairs = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns])
    dated = F.transform(pairs, lambda p: F.struct(p["field_name"].alias("field_name"), p["value"].alias("value"), epoch_us(p["value"], F.col(locale), F.col(zone), zones).alias("epoch_us")))
    return df.select(F.col(key).alias("row_key"), F.inline(F.filter(dated, lambda d: d["epoch_us"].isNotNull()))).distinct()
