"""Dates and intervals. An interval is struct(months, days, micros), as its parts don't convert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

DAY = 86_400_000_000


def interval(years: int = 0, months: int = 0, weeks: int = 0, days: int = 0, hours: int = 0, mins: int = 0, secs: float = 0.0) -> Column:
    return F.struct(F.lit(years * 12 + months).alias("months"), F.lit(weeks * 7 + days).alias("days"), F.lit(int((hours * 3600 + mins * 60) * 1_000_000 + round(secs * 1_000_000))).alias("micros"))


def _parts(months: Column, days: Column, micros: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def _toward_zero(x: Column, n: int) -> Column:
    return (F.signum(x.cast("double")) * F.floor(F.abs(x) / n)).cast("long")


def _once(i: Column, f: Callable[[Column], Column]) -> Column:
    """f of an interval that is worked out once, however often f uses its parts."""
    return F.transform(F.array(i), f)[0]


def justify_hours(i: Column) -> Column:
    """24 hours become a day; the parts get one sign."""
    return _once(i, _hours)


def _hours(i: Column) -> Column:
    d = _toward_zero(i["micros"], DAY)
    days, micros = i["days"] + d, i["micros"] - d * DAY
    fix = F.when((days > 0) & (micros < 0), F.lit(-1)).when((days < 0) & (micros > 0), F.lit(1)).otherwise(F.lit(0))
    return _parts(i["months"], days + fix, micros - fix * F.lit(DAY))


def justify_days(i: Column) -> Column:
    """30 days become a month."""
    return _once(i, _days)


def _days(i: Column) -> Column:
    m = _toward_zero(i["days"], 30)
    months, days = i["months"] + m, i["days"] - m * 30
    fix = F.when((months > 0) & (days < 0), F.lit(-1)).when((months < 0) & (days > 0), F.lit(1)).otherwise(F.lit(0))
    return _parts(months + fix, days - fix * 30, i["micros"])


def justify_interval(i: Column) -> Column:
    """Both, and then one sign for all parts."""
    return _once(justify_days(justify_hours(i)), _one_sign)


def _one_sign(j: Column) -> Column:
    months, days, micros = j["months"], j["days"], j["micros"]
    down = (months > 0) & ((days < 0) | ((days == 0) & (micros < 0)))
    up = (months < 0) & ((days > 0) | ((days == 0) & (micros > 0)))
    fix = F.when(down, F.lit(1)).when(up, F.lit(-1)).otherwise(F.lit(0))
    months, days = months - fix, days + fix * 30
    turn = F.when((days > 0) & (micros < 0), F.lit(1)).when((days < 0) & (micros > 0), F.lit(-1)).otherwise(F.lit(0))
    return _parts(months, days - turn, micros + turn * F.lit(DAY))


def add(ts: Column, i: Column) -> Column:
    """Months first, then days, then the time."""
    day = F.date_add(F.add_months(F.to_date(ts), i["months"]), i["days"])
    micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.to_date(ts).cast("timestamp")) + i["micros"]
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + micros)


def age(later: Column, earlier: Column) -> Column:
    """Symbolic difference: whole months, then days, then time, all of one sign."""
    a, b = F.greatest(later, earlier), F.least(later, earlier)
    clock = lambda x: F.unix_micros(x.cast("timestamp")) - F.unix_micros(F.to_date(x).cast("timestamp"))
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    days, micros = F.dayofmonth(a) - F.dayofmonth(b), clock(a) - clock(b)
    days, micros = F.when(micros < 0, days - 1).otherwise(days), F.when(micros < 0, micros + DAY).otherwise(micros)
    borrow = days < 0
    days, months = F.when(borrow, days + F.dayofmonth(F.last_day(b))).otherwise(days), F.when(borrow, months - 1).otherwise(months)
    sign = F.when(later >= earlier, F.lit(1)).otherwise(F.lit(-1))
    return _parts(months * sign, days * sign, micros * sign)


def isodow(d: Column) -> Column:
    """Monday is 1, Sunday 7."""
    return F.weekday(d) + 1


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Half-open time spans; the ends of a span may come in either order."""
    al, ah, bl, bh = F.least(a1, a2), F.greatest(a1, a2), F.least(b1, b2), F.greatest(b1, b2)
    return ((al < bh) & (bl < ah)) | (al == bl)


def make_time(hour: int, minute: int, second: float) -> Column:
    """Microseconds since midnight."""
    return F.lit(int((hour * 3600 + minute * 60) * 1_000_000 + round(second * 1_000_000))).cast("long")


#: Sentinels for infinite dates.
MINUS_INFINITY, INFINITY = "0001-01-01", "9999-12-31"


def isfinite(d: Column) -> Column:
    return ~d.cast("date").isin(F.lit(MINUS_INFINITY).cast("date"), F.lit(INFINITY).cast("date"))


#: Templates of to_char and the patterns that Spark has for them: fixed values.
TEMPLATES = {"YYYY": "yyyy", "MM": "MM", "DDD": "DDD", "DD": "dd", "HH24": "HH", "HH12": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "Month": "MMMM", "Mon": "MMM", "Day": "EEEE", "Dy": "EEE", "AM": "a", "PM": "a", "Q": "Q"}


def to_char(ts: Column, template: str) -> Column:
    """Formatted time, for the templates in TEMPLATES; other letters stand for themselves."""
    out, i = "", 0
    names = sorted(TEMPLATES, key=len, reverse=True)
    while i < len(template):
        name = next((n for n in names if template.startswith(n, i)), None)
        if name:
            out, i = out + TEMPLATES[name], i + len(name)
        else:
            c = template[i]
            out, i = out + (f"'{c}'" if c.isalpha() else c), i + 1
    return F.date_format(ts, out)


def from_template(text: Column, template: str) -> Column:
    """to_timestamp(): a time read by a template of TEMPLATES. Where the template has a blank or a mark, the text may have any run of these."""
    names, i, groups, pattern = sorted(TEMPLATES, key=len, reverse=True), 0, [], r"^\s*"
    kinds = {"Month": r"[A-Za-z]+", "Mon": r"[A-Za-z]{3}", "Day": r"[A-Za-z]+", "Dy": r"[A-Za-z]{3}", "AM": r"[AaPp][Mm]", "PM": r"[AaPp][Mm]", "YYYY": r"\d{4}", "MS": r"\d{1,3}", "US": r"\d{1,6}", "DDD": r"\d{1,3}"}
    while i < len(template):
        name = next((n for n in names if template.startswith(n, i)), None)
        if name:
            groups.append(name)
            pattern, i = pattern + f"({kinds.get(name, r'\d{1,2}')})", i + len(name)
        else:
            pattern, i = pattern + (r"\W*" if not template[i].isalnum() else ".?"), i + 1
    part = {n: F.regexp_extract(text, pattern, k + 1) for k, n in enumerate(groups)}
    number = lambda n, other: part[n].cast("int") if n in part else F.lit(other)
    month = number("MM", 1)
    for n in ("Month", "Mon"):
        if n in part:
            month = F.month(F.to_date(F.concat(F.lit("2000-"), F.initcap(F.substring(part[n], 1, 3)), F.lit("-01")), "yyyy-MMM-dd"))
    hour = number("HH24", 0)
    if "HH12" in part:
        late = F.lower(part["PM"] if "PM" in part else part["AM"]) == "pm" if {"AM", "PM"} & set(part) else F.lit(False)
        hour = number("HH12", 0) % 12 + F.when(late, 12).otherwise(0)
    second = number("SS", 0).cast("decimal(16,6)")
    for n, width in (("MS", 3), ("US", 6)):
        if n in part:
            second = second + F.concat(F.lit("0."), F.rpad(part[n], width, "0")).cast("decimal(16,6)")
    day = F.make_date(number("YYYY", 1), month, number("DD", 1))
    day = F.date_add(F.make_date(number("YYYY", 1), F.lit(1), F.lit(1)), number("DDD", 1) - 1) if "DDD" in part else day
    whole = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hour, number("MI", 0), second)
    return F.when(text.rlike(pattern), whole)


def to_date(text: Column, template: str) -> Column:
    return from_template(text, template).cast("date")


def to_number(text: Column, template: str) -> Column:
    """Digits, sign and decimal point of a text by a template of 9, 0, comma or G, point or D, S, MI and PR; the rest is skipped."""
    places = len(template.upper().replace("D", ".").partition(".")[2].translate({ord(c): None for c in "SMIPR "}))
    plain = F.regexp_replace(text, "[^0-9.]", "")
    negative = text.contains("-") | text.rlike(r"^\s*<.*>\s*$")
    value = plain.cast(f"decimal(38,{places})")
    return F.when(negative, -value).otherwise(value)


def now() -> Column:
    """now(), transaction_timestamp(): one time for all rows and uses of a statement."""
    return F.current_timestamp()


def timezone(zone: Column | str, ts: Column) -> Column:
    """ts AT TIME ZONE zone: a time of day there for a moment."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, ts.cast("timestamp_ntz"))


def make_timestamptz(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: str = "UTC") -> Column:
    return F.make_timestamp_ltz(year, month, day, hour, minute, second, F.lit(zone))
