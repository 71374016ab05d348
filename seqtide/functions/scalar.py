"""Scalar Column helpers: zones, buckets, times, texts, content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- zones and flags -------------------------------------------------------


def zone(value: ColumnLike, low: float = 45.0, high: float = 55.0,
         labels: tuple[str, str, str] = ("Bad", "Mid", "Good")) -> Column:
    """Three zones with strict limits; NULL stays NULL."""
    v = _c(value)
    return F.when(v < low, labels[0]).when(v > high, labels[2]).when(v.isNotNull(), labels[1])


def streak_category(streak: ColumnLike, threshold: int = 3) -> Column:
    s = _c(streak)
    return (
        F.when(s >= threshold, "Win_Streak").when(s <= -threshold, "Lose_Streak").otherwise("No_Streak")
    )


def outcome_symbol(win: ColumnLike, metric: ColumnLike, counter_below: float = 40.0) -> Column:
    """W for a win, C for a loss with the metric under the limit, L for another loss."""
    return F.when(_c(win) == 1, "W").when(_c(metric) < counter_below, "C").otherwise("L")


def clean_change(win: ColumnLike, change: ColumnLike) -> Column:
    """A missing change is 0, and so is a gain on a loss (the value hit a floor)."""
    return F.when((_c(win) == 0) & (_c(change) > 0), F.lit(0)).otherwise(F.coalesce(_c(change), F.lit(0)))


def stop_tier(gap: ColumnLike, long_s: int, quit_s: int) -> Column:
    g = _c(gap)
    return F.when(g.isNull(), "End").when(g >= quit_s, "Quit").when(g >= long_s, "Long").otherwise("Short")


def bucket(value: ColumnLike, width: float) -> Column:
    """Lower edge of the fixed-width bucket; floors, so it also holds below zero."""
    return (F.floor(_c(value) / F.lit(width)) * F.lit(width)).cast("long")


def is_finite(value: ColumnLike) -> Column:
    v = _c(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def report_round(value: Column, digits: int) -> Column:
    """Rounding for report columns. Nine digits first, so that sums taken in another order
    cannot fall on the other side of a half."""
    return F.round(F.round(value, 9), digits)


# --- numbers and texts -----------------------------------------------------


def clean_number(text: ColumnLike) -> Column:
    """"11,068 / 11309 PB" -> 11068, "+31" -> 31, "54%" -> 54; NULL when no number leads."""
    first = F.regexp_extract(F.regexp_replace(F.split(_c(text), "/")[0], "[,+\\s]", ""), r"^(-?\d+(\.\d+)?)", 1)
    return first.try_cast("double")


# Seconds per unit letter of a duration text.
UNIT_SECONDS = {"y": 31536000, "w": 604800, "d": 86400, "h": 3600, "m": 60}


def duration_seconds(text: ColumnLike) -> Column:
    """"9y 36w 5d" -> seconds; NULL for an empty text."""
    t = F.lower(F.trim(_c(text)))
    total = None
    for unit, seconds in UNIT_SECONDS.items():
        amounts = F.regexp_extract_all(t, F.lit(rf"(\d+)\s*{unit}"), F.lit(1))
        part = F.aggregate(amounts, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long")) * F.lit(seconds)
        total = part if total is None else total + part
    return F.when(F.length(t) > 0, total)


def duration_text(seconds: ColumnLike) -> Column:
    """Seconds -> "1 days, 2 hours, 3 minutes"; parts equal to zero are left out."""
    s = _c(seconds).cast("long")
    parts = [
        (F.floor(s / 86400), "days"),
        (F.floor(s % 86400 / 3600), "hours"),
        (F.floor(s % 3600 / 60), "minutes"),
    ]
    texts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"))) for n, unit in parts]
    joined = F.concat_ws(", ", *texts)
    return F.when(s.isNull(), F.lit(None)).when(joined == "", "< 1 minute").otherwise(joined)


def normal_name(name: ColumnLike) -> Column:
    """Normal form of a display name: lower case, a dash for every blank."""
    return F.translate(F.lower(_c(name)), " ", "-")


def item_key(name: ColumnLike, evo: ColumnLike) -> Column:
    """Normal name with the suffix of an evolved item."""
    return F.concat(normal_name(name), F.when(_c(evo) == 1, "-ev1").otherwise(""))


# --- time ------------------------------------------------------------------


def epoch_of(ts: ColumnLike) -> Column:
    """Whole epoch seconds of a zone-less timestamp, whatever the session time zone is."""
    t = _c(ts)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def utc_timestamp(epoch: ColumnLike) -> Column:
    """Zone-less UTC timestamp of epoch seconds, whatever the session time zone is."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return zero + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(epoch).cast("decimal(18,6)"))


def local_time(epoch: ColumnLike, tz: ColumnLike) -> Column:
    return F.convert_timezone(F.lit("UTC"), _c(tz), utc_timestamp(epoch))


def local_hour(epoch: ColumnLike, tz: ColumnLike) -> Column:
    return F.hour(local_time(epoch, tz))


def day_slot(hour: ColumnLike, width: int) -> Column:
    """Number of the ``width``-hour slot of the day."""
    return F.floor(_c(hour) / F.lit(width)).cast("long")


# Names of the 6-hour slots.
SLOT_NAMES = ("Night", "Morning", "Afternoon", "Evening")


def named_slot(hour: ColumnLike) -> Column:
    h = _c(hour)
    out = F.when(h < 6, SLOT_NAMES[0]).when(h < 12, SLOT_NAMES[1]).when(h < 18, SLOT_NAMES[2])
    return F.when(h.isNotNull(), out.otherwise(SLOT_NAMES[3]))


def year_week(ts: ColumnLike) -> Column:
    """Year and Monday-based week of the year, with week 0 before the first Monday."""
    t = _c(ts)
    monday_based = F.weekday(t)
    week = F.floor((F.dayofyear(t) + 6 - monday_based) / 7)
    return F.concat(F.year(t).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def first_monday(day: ColumnLike) -> Column:
    """First Monday of the month of ``day``."""
    return F.next_day(F.date_sub(F.trunc(_c(day), "month"), 1), "MON")


def season_days(day: ColumnLike) -> Column:
    """Days since the season start: the first Monday of this month, or of the month before."""
    d = F.to_date(_c(day))
    this, last = first_monday(d), first_monday(F.add_months(d, -1))
    return F.datediff(d, F.when(d >= this, this).otherwise(last))


# --- sets ------------------------------------------------------------------


def content_hash(items: ColumnLike, with_level: bool = True) -> Column:
    """SHA-256 of an unordered set of ``struct(name, level, evo, hero)``.

    The set is ordered by normal name. With the level the display name is hashed, without it
    the normal name: that second hash names the archetype.
    """

    def text(i: Column) -> Column:
        flags = [F.coalesce(i[c].cast("string"), F.lit("")) for c in ("evo", "hero")]  # a null keeps its place
        if with_level:
            return F.concat_ws(":", F.coalesce(i["name"], F.lit("")), F.coalesce(i["level"].cast("string"), F.lit("")), *flags)
        return F.concat_ws(":", F.coalesce(normal_name(i["name"]), F.lit("")), *flags)

    keyed = F.transform(_c(items), lambda i: F.struct(normal_name(i["name"]).alias("k"), text(i).alias("v")))
    return F.sha2(F.array_join(F.transform(F.array_sort(keyed), lambda s: s["v"]), ","), 256)


def jaccard_distance(a: ColumnLike, b: ColumnLike) -> Column:
    both = F.size(F.array_union(_c(a), _c(b)))
    return F.when(both > 0, 1 - F.size(F.array_intersect(_c(a), _c(b))) / both).otherwise(F.lit(0.0))


# --- json ------------------------------------------------------------------


def json_field(text: ColumnLike, path: str) -> Column:
    return F.get_json_object(_c(text), path)


def json_payload(**columns: ColumnLike) -> Column:
    return F.to_json(F.struct(*[_c(c).alias(name) for name, c in columns.items()]))
