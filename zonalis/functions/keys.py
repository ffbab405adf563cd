"""Key, string, date and code scalars (K1-K30) as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

CODE = r"^(\d{5}|2[AB]\d{3})$"
#: Prefixes of areas outside the mainland.
OVERSEAS = ("97", "98", "99")
#: Mainland bounding box, west, south, east, north.
METRO_BOX = (-5.4, 41.2, 9.8, 51.2)


def normalise_code(value: Column) -> Column:
    """Area code as five characters; NULL where it can't be one (K1)."""
    text = F.regexp_replace(F.upper(F.trim(value.cast("string"))), r"\.0$", "")
    text = F.when(text.rlike(r"^\d{1,4}$"), F.lpad(text, 5, "0")).otherwise(text)
    return F.when(text.rlike(CODE), text)


def is_metropolitan(code: Column) -> Column:
    return F.coalesce((F.length(code) > 0) & ~F.substring(code, 1, 2).isin(*OVERSEAS), F.lit(False))


def department(code: Column) -> Column:
    return F.when(F.substring(code, 1, 2).isin("97", "98"), F.substring(code, 1, 3)).otherwise(F.substring(code, 1, 2))


def joined_code(dep: Column, town: Column) -> Column:
    """Department and three-digit town number as one code (K4)."""
    return normalise_code(F.concat(F.trim(dep), F.lpad(F.trim(town.cast("string")), 3, "0")))


def number(text: Column) -> Column:
    """Decimal comma, percent sign and blanks allowed; NULL for anything else, NaN and infinities too (K5)."""
    return finite(F.translate(F.trim(text), ",%  ", ".").try_cast("double"))


def suppressed_number(text: Column, markers: Sequence[str] = ("s", "ND", "NA", "")) -> Column:
    """Markers of withheld values and blanks are NULL (K6)."""
    trimmed = F.trim(text)
    return F.when(~trimmed.isin(*markers), number(trimmed))


def uic8(value: Column) -> Column:
    """Last eight digits, padded with zeros (K7)."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(value.cast("string")), r"\.0$", ""), r"[^0-9]", "")
    return F.when(digits != "", F.right(F.lpad(digits, F.greatest(F.lit(8), F.length(digits)), F.lit("0")), F.lit(8)))


def best_grade(packed: Column, grades: Sequence[str] = ("A", "B", "C")) -> Column:
    """Strongest of ;-joined grades, the first listed being the strongest (K8)."""
    parts = F.transform(F.split(packed, ";"), lambda p: F.upper(F.trim(p)))
    return F.get(F.filter(F.array(*map(F.lit, grades)), lambda g: F.array_contains(parts, g)), F.lit(0))


def age_index(code: Column) -> Column:
    """Y0 to Y99 as years, older and Y_GE100 as 100 (K9)."""
    years = F.regexp_extract(code, r"^Y(\d+)$", 1).try_cast("int")
    return F.when(code == "Y_GE100", F.lit(100)).otherwise(F.least(years, F.when(years.isNotNull(), F.lit(100))))


def clock_minutes(text: Column) -> Column:
    """Minutes of HH:MM:SS, beyond 24 hours too."""
    parts = F.split(text, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def typical_week(start: Column, pinned: Column | None = None) -> Column:
    """Seven dates from the first Monday a week or more after ``start``, or from a pinned Monday."""
    monday = F.next_day(F.date_add(start, 6), "Mon")
    if pinned is not None:
        monday = F.coalesce(F.when((F.dayofweek(pinned) == 2), pinned), F.when(pinned.isNull(), monday))
    return F.sequence(monday, F.date_add(monday, 6))


def stop_parts(stop: Column) -> dict[str, Column]:
    """Product and code of StopPoint:OCE<product>-<code>."""
    pattern = r"^StopPoint:OCE(.+)-(\d+)$"
    return {"product": F.nullif(F.regexp_extract(stop, pattern, 1), F.lit("")), "code": F.nullif(F.regexp_extract(stop, pattern, 2), F.lit(""))}


def plan_state(stage: Column, detail: Column) -> Column:
    """Lifecycle of a prevention plan from its stage and detail, first match."""
    stage, detail = F.coalesce(F.trim(stage), F.lit("")), F.coalesce(F.trim(detail), F.lit(""))
    return (
        F.when((stage == "Opposable") | (detail == "Approuvé"), "approuve")
        .when((stage == "Prescrit") | detail.isin("Prescrit", "Prorogé", "Anticipé"), "prescrit")
        .when((stage == "Caduque") | detail.isin("Abrogé", "Annulé", "Déprescrit"), "caduque")
    )


def founding_year(text: Column) -> Column:
    return F.regexp_extract(text, r"(1[89]\d\d|20[0-2]\d)", 1).try_cast("int")


#: Reach patterns with weights, and longevity factors by founding year.
REACH = (("internation|inernation|mondial", 3.0), ("national", 3.0), ("r[ée]gion|transfronti", 2.0), ("d[ée]partement", 1.3))
LONGEVITY = ((1990, 1.5), (2010, 1.2))


def reach_weight(text: Column, year: Column, patterns=REACH, longevity=LONGEVITY) -> Column:
    """First matching pattern's weight times the longevity factor, to two decimals."""
    reach, factor = F.lit(1.0), F.lit(1.0)
    for pattern, weight in reversed(patterns):
        reach = F.when(F.coalesce(text, F.lit("")).rlike("(?iu)" + pattern), F.lit(weight)).otherwise(reach)
    for before, value in reversed(longevity):
        factor = F.when(year < before, F.lit(value)).otherwise(factor)
    return F.bround(reach * factor, 2)


def museum_weight(visitors: Column, reference: float = 10_000.0, least: float = 0.5, most: float = 6.0, unreported: float = 1.0) -> Column:
    """1 + log10 of visitors against the reference, clamped; unreported counts 1."""
    return F.when(visitors.isNull(), F.lit(unreported)).otherwise(F.least(F.greatest(1 + F.log10(visitors / reference), F.lit(least)), F.lit(most)))


def span_days(text: Column) -> Column:
    """Days of a plain number or of a span like '2 days 12:00:00' (K17)."""
    part = lambda pattern: F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(0.0))
    clock = part(r"(\d+):\d+:\d+") / 24 + part(r"\d+:(\d+):\d+") / 1440 + part(r"\d+:\d+:(\d+(?:\.\d+)?)") / 86400
    span = part(r"(-?\d+) days?") + clock
    return F.coalesce(text.try_cast("double"), F.when(text.rlike(r"\d+:\d+:\d+|days?"), span))


def class_lookup(value: Column, names: Mapping[str, str], default: str | None = None) -> Column:
    """Code to class by a fixed table (K18); codes outside it get ``default``."""
    out = F.lit(default)
    for code, name in names.items():
        out = F.when(value == code, F.lit(name)).otherwise(out)
    return out


def step_class(value: Column, cuts: Sequence[tuple[float, str]], above: str) -> Column:
    """The first class whose cut the value doesn't exceed."""
    out = F.lit(above)
    for cut, name in reversed(cuts):
        out = F.when(value <= cut, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def floor_tier(value: Column, tiers: Sequence[tuple[float, int]]) -> Column:
    """The first tier whose floor the value reaches, tiers descending; the last one otherwise."""
    out = F.lit(tiers[-1][1])
    for floor, tier in reversed(tiers):
        out = F.when(value >= floor, F.lit(tier)).otherwise(out)
    return out


def food_class(large: Column, general: Column, specialist: Column) -> Column:
    return F.when(large > 0, "supermarche").when(general > 0, "proximite").when(specialist > 0, "specialise").otherwise("aucun")


def coast_class(flood: Column, retreat: Column) -> Column:
    return F.when(flood & retreat, "les_deux").when(flood, "submersion").when(retreat, "recul").otherwise("aucun")


def is_highspeed(flag: Column, name: Column) -> Column:
    upper = F.upper(F.coalesce(name, F.lit("")))
    return F.coalesce(flag, F.lit(False)) | upper.contains("LGV") | upper.contains("GRANDE VITESSE") | upper.contains("LIGNE NOUVELLE")


def first_name(packed: Column) -> Column:
    """First of /-packed names, trimmed, NULL when blank."""
    return F.nullif(F.trim(F.split(packed, "/")[0]), F.lit(""))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def finite(value: Column) -> Column:
    """``value``, NULL where it is NaN or infinite: neither is a value."""
    return F.when(F.abs(value) < float("inf"), value)


def finite_of(df: DataFrame, column: str) -> Column:
    """A column's values: finite() of a floating one, any other as it is."""
    return finite(F.col(column)) if isinstance(df.select(column).schema[0].dataType, (FloatType, DoubleType)) else F.col(column)


def moment_label(ts: Column) -> Column:
    """Midnight as a date, other moments to the second."""
    return F.when(F.date_trunc("day", ts) == ts, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))


def declared_number(text: Column) -> Column:
    """A declared numeric as published: four decimals at most, NULL where it doesn't parse."""
    value = F.trim(text).try_cast("double")
    return F.bround(finite(value), 4)


#: Accented letters and their plain forms; ligatures are handled apart.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def folded_name(name: Column) -> Column:
    """Lower case without accents or ligatures, other signs as blanks."""
    text = F.translate(F.lower(name), ACCENTED, PLAIN)
    return F.regexp_replace(F.replace(F.replace(text, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae")), "[^a-z0-9]", " ")


#: City code and its range of district codes.
DISTRICTS = (("75056", 75101, 75120), ("69123", 69381, 69389), ("13055", 13201, 13216))


def parent_code(code: Column, ranges=DISTRICTS) -> Column:
    """City of a district code; other codes stay."""
    n, out = code.try_cast("int"), code
    for city, low, high in ranges:
        out = F.when(n.between(low, high), F.lit(city)).otherwise(out)
    return out


def snapped(value: Column, step: float, offset: float = 0.0) -> Column:
    """Nearest lattice value, ties to even."""
    return F.lit(offset) + F.rint((value - offset) / step) * step


def tile_key(lon: Column, lat: Column) -> Column:
    """One-degree tile such as N48_E002."""
    la, lo = F.floor(lat), F.floor(lon)
    side = lambda v, plus, minus, width: F.concat(F.when(v >= 0, F.lit(plus)).otherwise(F.lit(minus)), F.lpad(F.abs(v).cast("string"), width, "0"))
    return F.concat_ws("_", side(la, "N", "S", 2), side(lo, "E", "W", 3))


def delta_encoded(values: Column, scale: float = 1e5) -> Column:
    """First value and differences of coordinates in units of 1 / scale."""
    units = F.transform(values, lambda v: F.rint(v * scale).cast("bigint"))
    return F.transform(units, lambda v, i: F.when(i == 0, v).otherwise(v - F.get(units, i - 1)))


def delta_decoded(deltas: Column, scale: float = 1e5) -> Column:
    """Prefix sums of delta_encoded, in degrees."""
    start = F.array().cast("array<bigint>")
    sums = F.aggregate(deltas, start, lambda acc, d: F.array_append(acc, d + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint"))))
    return F.transform(sums, lambda v: v / scale)


def duration_label(minutes: Column) -> Column:
    """'45 min' or '1h05' (K30)."""
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.lpad((minutes % 60).cast("string"), 2, "0")))


def frequency_label(runs: Column) -> Column:
    """'40/day', or '3/week' below one a day."""
    return F.when(runs >= 7, F.concat(F.floor(runs / 7.0 + 0.5).cast("bigint").cast("string"), F.lit("/day"))).otherwise(F.concat(runs.cast("string"), F.lit("/week")))


def strength_words(r: Column) -> Column:
    a = F.abs(r)
    how = F.when(a < 0.3, "a weak").when(a < 0.5, "a moderate").when(a < 0.7, "a strong").otherwise("a very strong")
    sign = F.when(r > 0, "positive").otherwise("negative")
    return F.when(r.isNull() | F.isnan(r), "no relationship could be computed").when(a < 0.1, "no linear relationship nationally").otherwise(F.concat_ws(" ", how, sign, F.lit("relationship nationally")))


def short_label(text: Column) -> Column:
    return F.substring_index(F.substring_index(text, " — ", 1), " (", 1)


def published_if(value: Column, denominator: Column, least: float) -> Column:
    """The value where its denominator reaches the floor, else NULL (F8)."""
    return F.when(denominator >= least, value)


def rate(part: Column, whole: Column, least: float = 30.0) -> Column:
    """100 * part / whole above the floor."""
    return published_if(F.try_divide(100.0 * part, whole), whole, least)
