"""Numbers, times, directions, colors and names as people read them; Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTIONS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
DAY = 24_000


def number(v: Column) -> Column:
    """Thousands with commas from ten up or when whole, else one decimal."""
    return F.when((v >= 10) | (v == F.round(v)), F.format_number(F.round(v).cast("long"), 0)).otherwise(F.format_string("%.1f", v))


def short(v: Column) -> Column:
    """Rounded to three decimals, without zeros at the end."""
    return F.regexp_replace(F.format_string("%.3f", F.round(v, 3)), r"\.?0+$", "")


def percent(v: Column) -> Column:
    """A fraction up to one counts as a share."""
    return F.concat(short(F.when(v <= 1, v * 100).otherwise(v)), F.lit("%"))


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def count_of(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))


def duration(seconds: Column) -> Column:
    """Hours and minutes; seconds only below an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    parts = F.concat_ws(" ", F.when(h > 0, count_of(h, "hour")), F.when(m > 0, count_of(m, "minute")), F.when((s > 0) & (h == 0), count_of(s, "second")))
    return F.when(parts == "", "a moment").otherwise(parts)


def ticks_duration(ticks: Column) -> Column:
    """Twenty ticks are a second; rounded to minutes."""
    seconds = F.greatest(F.floor(ticks / 20), F.lit(0))
    minutes = F.floor(seconds / 60.0 + 0.5)
    h, rest = F.floor(minutes / 60), minutes % 60
    long = F.concat(count_of(h, "hour"), F.when(rest > 0, F.concat(F.lit(" "), count_of(rest, "minute"))).otherwise(""))
    return F.when(seconds < 60, "less than a minute").when(minutes < 60, count_of(minutes, "minute")).otherwise(long)


def direction(dx: Column, dz: Column) -> Column:
    """Eight directions of a step east (dx) and south (dz)."""
    angle = F.degrees(F.atan2(dx, -dz))
    return F.element_at(F.array(*map(F.lit, DIRECTIONS)), (F.floor(F.pmod(angle + 360, F.lit(360.0)) / 45 + 0.5) % 8 + 1).cast("int"))


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """sRGB (0 to 255) to CIELAB under D65."""
    lin = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    r, g, b = lin(r), lin(g), lin(b)
    x = (0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.95047
    y = 0.2126 * r + 0.7152 * g + 0.0722 * b
    z = (0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.08883
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    return {"l": 116 * f(y) - 16, "a": 500 * (f(x) - f(y)), "b": 200 * (f(y) - f(z))}


def clock(time: Column) -> Column:
    """Clock time 0 is 06:00; a thousand ticks are an hour."""
    minutes = F.floor(F.pmod(time, F.lit(DAY)) * 3 / 50)
    return F.concat(F.lpad(((F.floor(minutes / 60) + 6) % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def is_day(time: Column) -> Column:
    t = F.pmod(time, F.lit(DAY))
    return (t < 12_000) | (t >= 23_000)


def calendar(day_number: Column) -> dict[str, Column]:
    """Year, month and day of a count of days (from 0), in years of always 365 days."""
    of_year = F.pmod(day_number, F.lit(365))
    before, month, day = 0, F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, n in enumerate(MONTH_DAYS):
        inside = of_year >= before
        month, day = F.when(inside, i + 1).otherwise(month), F.when(inside, of_year - before + 1).otherwise(day)
        before += n
    return {"year": F.floor(day_number / 365) + 1, "month": month, "day": day}


def season(month: Column) -> Column:
    return F.when((month <= 2) | (month == 12), "Winter").when(month <= 5, "Spring").when(month <= 8, "Summer").otherwise("Autumn")


def greeting(hour: Column) -> Column:
    return F.when(hour.between(5, 11), "greeting_morning").when(hour.between(12, 17), "greeting_afternoon").when(hour.between(18, 22), "greeting_evening").otherwise("greeting_night")


def plural(word: Column) -> Column:
    return F.when(word.endswith("s"), word).when(word.endswith("y"), F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit("ies"))).otherwise(F.concat(word, F.lit("s")))


def title_case(name: Column, small: list[str]) -> Column:
    """snake_case to words; small words stay small unless first."""
    w = F.split(name, "_")
    return F.array_join(F.transform(w, lambda x, i: F.when((i > 0) & x.isin(small), x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 100))))), " ")


def singulars(text: Column) -> Column:
    """Sorted distinct words, with a plain plural s off, without "of"."""
    w = F.regexp_extract_all(F.lower(F.regexp_replace(text, "_", " ")), F.lit("[a-z0-9]+"), F.lit(0))
    one = F.transform(w, lambda x: F.when((F.length(x) > 3) & x.endswith("s") & ~x.endswith("ss"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return F.array_sort(F.array_distinct(F.filter(one, lambda x: x != "of")))


def escape(text: Column) -> Column:
    """Signs of chat markup with a backslash before them."""
    return F.regexp_replace(text, r"([*_~`|>\\])", r"\\$1")
