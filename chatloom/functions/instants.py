"""Time stamps of any form, precision and zone -> one UTC instant.

All written forms are alternatives of one regular expression with named groups. One ``regexp_replace`` rewrites a
stamp into its components (so the expression runs once per value), which are then validated against the calendar
and put together by integer day arithmetic. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import fresh

# Offsets of zone abbreviations from UTC in minutes. An abbreviation that several zones share has the
# reading of the most populous one; such text is rare, as exporters write numeric offsets.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "UT": 0,
    "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "SAST": 120,
    "IST": 330, "NPT": 345, "PKT": 300, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "ART": -180, "BRT": -180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "COT": -300, "PET": -300, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

# The first letters of month names in the six languages of the exports, January first.
MONTH_PREFIXES = [
    ("jan", "ene", "янв"), ("feb", "fev", "fév", "фев"), ("mar", "mär", "mrz", "мар"), ("apr", "abr", "avr", "апр"),
    ("may", "mai", "мая", "май"), ("jun", "juin", "июн"), ("jul", "juil", "июл"), ("aug", "ago", "aoû", "авг"),
    ("sep", "set", "сен"), ("oct", "okt", "out", "окт"), ("nov", "ноя"), ("dec", "dez", "dic", "déc", "дек"),
]

_WS = r"[\s  ]"
_DATE = [
    r"(?<iy>\d{4})[-/.](?<im>\d{1,2})[-/.](?<id>\d{1,2})",
    r"(?<na>\d{1,2})(?<sep>[/.-])(?<nb>\d{1,2})[/.-](?<ny>\d{4}|\d{2})",
    rf"(?:\p{{L}}{{2,10}}\.?,?{_WS}+)?(?<dd>\d{{1,2}})\.?[{_WS[1:-1]}-]+(?<dm>\p{{L}}{{3,10}})\.?,?[{_WS[1:-1]}-]+(?<dy>\d{{4}}|\d{{2}})",
    rf"(?:\p{{L}}{{2,10}}\.?,{_WS}+)?(?<mm>\p{{L}}{{3,10}})\.?{_WS}+(?<md>\d{{1,2}}),?{_WS}+(?<my>\d{{4}})",
]
_TIME = (
    rf"(?<h>\d{{1,2}}):(?<mi>\d{{2}})(?::(?<s>\d{{2}})(?:[.,](?<f>\d{{1,9}}))?)?(?:{_WS}*(?<ap>[AaPp])\.?[Mm]\.?)?"
    rf"(?:{_WS}*(?:(?:UTC|GMT)?(?<os>[+−-])(?<oh>\d{{2}})(?::?(?<om>\d{{2}}))?|(?<zn>[A-Za-z]{{1,5}})))?"
)
_EPOCH = r"(?<ep>[+-]?\d{1,20}(?:\.\d{0,12})?(?:[eE][+]?\d{1,2})?)"
#: Java syntax. Group names follow: i = year first, n = all numbers, d = day before month name, m = month name first.
STAMP_PATTERN = (
    rf"^{_WS}*(?:{_EPOCH}|(?:{'|'.join(_DATE)})(?:(?:[Tt]|,?{_WS}+){_TIME})?){_WS}*$"
)
_PARTS = ["iy", "im", "id", "na", "sep", "nb", "ny", "day", "mon", "year", "h", "mi", "s", "f", "ap", "os", "oh", "om", "zn", "ep"]
_SOURCE = {"day": "${dd}${md}", "mon": "${dm}${mm}", "year": "${dy}${my}"}
_MARK = "\u0001"
_SHAPE = _MARK + "|".join(_SOURCE.get(p, f"${{{p}}}") for p in _PARTS)

# Timestamps that both Spark and Python can hold: the years 1 to 9999.
_LOW, _HIGH = -62_135_596_800_000_000, 253_402_300_799_999_999


def _safe(micros: Column) -> Column:
    return F.when(micros.between(_LOW, _HIGH), F.timestamp_micros(micros))


def epoch_instant(value: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds since 1970, told apart by magnitude, as an instant.

    A count below 1e11 is seconds (years before 5138), below 1e14 milliseconds, below 1e17 microseconds, else
    nanoseconds; fractions finer than a microsecond are cut. Null and what isn't a number give null.
    """
    v = value.try_cast("decimal(38,9)")
    size = F.abs(v)
    micros = (
        F.when(size < F.lit(10**11), v * 1_000_000)
        .when(size < F.lit(10**14), v * 1_000)
        .when(size < F.lit(10**17), v)
        .otherwise(v / 1_000)
    )
    return _safe(F.floor(micros).try_cast("bigint"))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, in integer arithmetic only (years counted from March)."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return era * 146_097 + doe - 719_468


def _month_number(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for n, prefixes in enumerate(MONTH_PREFIXES, 1):
        hit = low.rlike("^(?:" + "|".join(prefixes) + ")")
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out


def known_zones(df: DataFrame) -> list[str]:
    """The zone names the running JVM knows (about 600)."""
    jvm = df.sparkSession._jvm
    return sorted(jvm.java.time.ZoneId.getAvailableZoneIds())


def with_instant(df: DataFrame, stamp: str, zone: str | None = None, order: str | None = None, out: str = "instant") -> DataFrame:
    """Adds *out* TIMESTAMP, the instant that the text in column *stamp* states, or null.

    *zone* names a column of IANA zones for text without a zone of its own, *order* one of ``dmy``/``mdy`` for
    all-number dates with slashes or dashes (dotted ones are day first everywhere; an order that gives no date is
    swapped).

    Defined cases: null, empty or blank text, text that is no date, a lone time of day, impossible dates
    (29 February of a common year, hour 25, hour 13 with PM) give null. A wall time without a usable zone (null or
    unknown name) gives null. A wall time that the autumn change repeats is the earlier instant; one that the spring
    change skips moves forward by the gap. A date without time is midnight. Two-digit years 70-99 are 19xx. Counts
    since 1970 are told apart as in :func:`epoch_instant`. Other columns, also ones with clashing names, stay.
    """
    raw, parts, wall, cy, cm, cd = fresh(df, "stamp_raw", "stamp_parts", "stamp_wall", "stamp_y", "stamp_m", "stamp_d")
    s = F.col(f"`{stamp}`").cast("string")
    z = F.col(f"`{zone}`") if zone else F.lit(None).cast("string")
    o = F.lower(F.col(f"`{order}`")) if order else F.lit("dmy")
    df = df.withColumn(raw, F.regexp_replace(s, STAMP_PATTERN, _SHAPE))
    df = df.withColumn(parts, F.when(F.col(raw).startswith(_MARK), F.split(F.substring(F.col(raw), 2, 1_000), r"\|")))

    def text(p: str) -> Column:
        return F.nullif(F.col(parts)[_PARTS.index(p)], F.lit(""))

    def num(p: str) -> Column:
        return text(p).try_cast("int")

    day_first = (text("sep") == ".") | (o != "mdy") | o.isNull()
    a, b = num("na"), num("nb")
    swapped = F.when(F.when(day_first, b).otherwise(a) > 12, True).otherwise(False)
    keep = day_first != swapped
    year = F.coalesce(num("iy"), num("ny"), num("year"))
    short = F.length(F.coalesce(text("iy"), text("ny"), text("year"))) == 2
    year = F.when(short, year + F.when(year >= 70, 1900).otherwise(2000)).otherwise(year)
    month = F.coalesce(num("im"), F.when(keep, b).otherwise(a), _month_number(text("mon")))
    dom = F.coalesce(num("id"), F.when(keep, a).otherwise(b), num("day"))
    df = df.withColumns({cy: year, cm: month, cd: dom})

    y, m, d = F.col(cy), F.col(cm), F.col(cd)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    h, mi, sec = F.coalesce(num("h"), F.lit(0)), F.coalesce(num("mi"), F.lit(0)), F.coalesce(num("s"), F.lit(0))
    half = F.lower(text("ap"))
    hour_ok = F.when(half.isNotNull(), h.between(1, 12)).otherwise(h <= 23)
    hour = F.when(half.isNotNull(), h % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(h)
    valid = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest) & hour_ok & (mi <= 59) & (sec <= 59)
    frac = F.coalesce(F.rpad(F.substring(text("f"), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    seconds = days_from_civil(y, m, d) * 86_400 + hour * 3_600 + mi * 60 + sec
    df = df.withColumn(wall, F.when(valid, seconds.cast("bigint") * 1_000_000 + frac))

    named = F.upper(text("zn"))
    table = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    oh, om = num("oh"), F.coalesce(num("om"), F.lit(0))
    offset = F.when((oh <= 18) & (om <= 59), (oh * 60 + om) * F.when(text("os") == "+", 1).otherwise(-1))
    minutes = F.when(text("os").isNotNull(), offset).when(named.isNotNull(), F.try_element_at(table, named))
    own = text("os").isNotNull() | named.isNotNull()
    good = F.when(z.isin(known_zones(df)), z)
    stated = (
        F.when(text("ep").isNotNull(), epoch_instant(text("ep")))
        .when(own, _safe(F.col(wall) - minutes.cast("bigint") * 60_000_000))
        .otherwise(F.to_utc_timestamp(_safe(F.col(wall)), good))
    )
    return df.withColumn(out, stated).drop(raw, parts, wall, cy, cm, cd)
