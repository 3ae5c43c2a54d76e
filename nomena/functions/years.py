"""Years: plausibility, spans, years in texts. A year of 0 and a missing year both mean unknown; bounds are inclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Corpora whose documents' dates tell when the persons named in them lived.
DATE_ANCHORS = ("hipe2020", "newseye", "sonar", "topres19th")
#: A year that stands alone in a text.
YEAR = r"\b(1[0-9]{3}|20[0-2][0-9])\b"


def known(y: Column) -> Column:
    return F.nullif(y, F.lit(0))


def covers(start: Column, end: Column, year: Column) -> Column:
    """Both bounds and the year are known and start <= year <= end; false otherwise."""
    return F.coalesce(year.between(known(start), known(end)), F.lit(False))


def year_score(year: Column, in_period: Column, birth: Column, death: Column, has_periods: Column, slack: int = 5) -> Column:
    """3 in a period, 2 in the lifetime, -1 outside the lifetime (both ends known) by more than slack, 1 with any period, else 0; 0 without a year."""
    b, d = known(birth), known(death)
    inside, outside = year.between(b, d), ~year.between(b - slack, d + slack)
    return F.when(year.isNull(), F.lit(0)).when(in_period, F.lit(3)).when(F.coalesce(inside, F.lit(False)), F.lit(2)).when(F.coalesce(outside, F.lit(False)), F.lit(-1)).when(has_periods, F.lit(1)).otherwise(F.lit(0))


def relink_score(periods: Column, year: Column, birth: Column, death: Column) -> Column:
    """struct(flag, distance): 16 if a period covers the year, else if a period began by then and ended at most 50 years before; 8 if a bound lies within 10 years; 16 in the lifetime.

    The first period in order that meets the first of these tests decides; distance is to its middle, its end, its nearer bound, the middle of the life. 0 and a billion if none holds.
    """
    p = F.filter(periods, lambda x: known(x["start_year"]).isNotNull() & known(x["end_year"]).isNotNull())
    y, b, d = known(year), known(birth), known(death)
    first = lambda test: F.get(F.filter(p, test), F.lit(0))
    covering, late = first(lambda x: y.between(x["start_year"], x["end_year"])), first(lambda x: y.between(x["start_year"], x["end_year"] + 50))
    near = first(lambda x: (F.abs(y - x["start_year"]) <= 10) | (F.abs(y - x["end_year"]) <= 10))
    of = lambda flag, dist: F.struct(F.lit(flag).alias("flag"), dist.cast("double").alias("distance"))
    middle = lambda a, z: F.abs(y - (a + z) / 2)
    return (
        F.when(covering.isNotNull(), of(16, middle(covering["start_year"], covering["end_year"])))
        .when(late.isNotNull(), of(16, F.abs(y - late["end_year"])))
        .when(near.isNotNull(), of(8, F.least(F.abs(y - near["start_year"]), F.abs(y - near["end_year"]))))
        .when(y.between(b, d), of(16, middle(b, d)))
        .otherwise(of(0, F.lit(1e9)))
    )


def match_flags(kana: Column, daime: Column, close: Column, in_year: Column) -> Column:
    """Bits: reading 2, generation 4, near 8, year 16."""
    bit = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    return bit(kana, 2).bitwiseOR(bit(daime, 4)).bitwiseOR(bit(close, 8)).bitwiseOR(bit(in_year, 16))


def shown_bits(flags: Column) -> Column:
    return F.lpad(F.bin(flags), 7, "0")


def shown_year(y: Column) -> Column:
    return F.when(y < 0, F.concat((-y).cast("string"), F.lit(" BC"))).otherwise(y.cast("string"))


def signed_year(time: Column) -> Column:
    """The year of a signed time stamp such as +1900-06-26T00:00:00Z; null if there is none."""
    return F.regexp_extract(F.coalesce(time, F.lit("")), r"^([+-]\d{1,5})-", 1).try_cast("int")


def span(a: Column, b: Column) -> Column:
    """Both years around an en dash, ? for an unknown one; a single ? if both are unknown."""
    show = lambda x: F.coalesce(known(x).cast("string"), F.lit("?"))
    return F.when(F.coalesce(known(a), known(b)).isNull(), F.lit("?")).otherwise(F.concat(show(a), F.lit("–"), show(b)))


def own_periods(periods: Column, birth: Column, death: Column, margin: int = 10) -> Column:
    """The periods that can be the person's: those whose known bounds all lie beyond the lifetime, by more than margin years, go; all stay if neither end of the life is given."""
    low, high = F.coalesce(birth, F.lit(-9999)) - margin, F.coalesce(death, F.lit(9999)) + margin
    s, e = lambda p: known(p["start_year"]), lambda p: known(p["end_year"])
    foreign = lambda p: F.coalesce((F.least(s(p), e(p)) > high) | (F.greatest(s(p), e(p)) < low), F.lit(False))
    return F.when(birth.isNull() & death.isNull(), periods).otherwise(F.filter(periods, lambda p: ~foreign(p)))


def active_window(periods: Column, birth: Column, death: Column) -> Column:
    """struct(low, high) over all known years of the person's own periods, birth and death; null if there are none."""
    own = own_periods(periods, birth, death)
    bounds = lambda f: F.coalesce(F.transform(own, lambda p: known(p[f]).cast("int")), F.array().cast("array<int>"))
    years = F.array_compact(F.concat(bounds("start_year"), bounds("end_year"), F.array(known(birth).cast("int"), known(death).cast("int"))))
    return F.when(F.size(years) > 0, F.struct(F.array_min(years).alias("low"), F.array_max(years).alias("high")))


def active_at(window: Column, year: Column, slack: int = 5) -> Column:
    """Whether the year lies in the window, give or take slack years."""
    return F.coalesce(year.between(window["low"] - slack, window["high"] + slack), F.lit(False))


def context_year(year: Column, left: Column, right: Column | None = None) -> Column:
    """The row's year, else the first year token of its context."""
    t = F.coalesce(left, F.lit("")) if right is None else F.concat(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit("")))
    return F.coalesce(year, F.regexp_extract(t, r"年[:：](\d{3,4})", 1).try_cast("int"))


def document_year(year: Column, dataset: Column, date: Column) -> Column:
    """The row's year; else, only in corpora whose dates anchor the persons named, the first year in the date."""
    found = F.regexp_extract(F.coalesce(date, F.lit("")), YEAR, 1).try_cast("int")
    return F.coalesce(year, F.when(dataset.isin(*DATE_ANCHORS), found))


def as_year(value: Column) -> Column:
    """A year from a text: a whole number from 1000 to 2100, else the first year that stands alone in it."""
    n = value.try_cast("int")
    whole = value.rlike(r"^\s*-?\d+\s*$")
    return F.when(whole, F.when(n.between(1000, 2100), n)).otherwise(F.regexp_extract(F.coalesce(value, F.lit("")), YEAR, 1).try_cast("int"))


def described_span(description: Column) -> Column:
    """The patterns are fixed values, tried in order. A span of years told by a description: years of birth and death in brackets, one year in brackets, a century, a floruit, a year; the first of these that occurs, empty without any."""
    d = F.coalesce(description, F.lit(""))
    both = r"(?i)\((?:b\.?\s*)?(\d{3,4})\s*[–-]\s*(\d{3,4})?\)"
    a, z = F.regexp_extract(d, both, 1), F.regexp_extract(d, both, 2)
    one, century = F.regexp_extract(d, r"\(\s*(\d{3,4})\s*\)", 1), F.regexp_extract(d, r"(?i)\b\d{1,2}(?:st|nd|rd|th)\s+century\b", 0)
    floruit, year = F.regexp_extract(d, r"(?i)\bfl\.?\s*(\d{3,4})\b", 1), F.regexp_extract(d, YEAR, 1)
    return F.when(a != "", F.when(z != "", F.concat(a, F.lit("–"), z)).otherwise(F.concat(F.lit("b. "), a))).when(one != "", one).when(century != "", century).when(floruit != "", F.concat(F.lit("fl. "), floruit)).otherwise(year)


def stage_years(text: Column) -> Column:
    """The pattern is a fixed value. struct(start, end) of a period of activity: the years in wide brackets before and after the wave dash; null where there is none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[〜～]")
    at = lambda i: F.regexp_extract(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"（(\d{4})）", 1).try_cast("int")
    return F.struct(at(0).alias("start"), F.when(F.size(parts) > 1, at(1)).alias("end"))
