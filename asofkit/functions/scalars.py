"""Scalar functions of the feature engine, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a missing index, a missing label, an unseen ratio.
MISSING = -1000
UNKNOWN = "UNK"
NO_RATIO = 10_000
NO_COMPARISON = 1_000_000

#: The letters of action types.
ACTION_LETTERS = {
    "change of sort order": "a",
    "clickout item": "b",
    "filter selection": "c",
    "interaction item deals": "d",
    "interaction item image": "e",
    "interaction item info": "f",
    "interaction item rating": "j",
    "search for destination": "g",
    "search for item": "h",
    "search for poi": "i",
}
ITEM_ACTIONS = ("clickout item", "interaction item deals", "interaction item image", "interaction item info", "interaction item rating", "search for item")


def index_of(items: Column | str, item: Column) -> Column:
    """Position (from 0) of the first equal element, null if there is none or *item* is null."""
    at = F.array_position(items, item)
    return F.when(at > 0, (at - 1).cast("int"))


def time_bucket(seconds: Column) -> Column:
    """Seconds up to 12 as they are, beyond by steps of four."""
    return F.when(seconds <= 12, seconds).otherwise(F.floor(seconds / 4) * 4)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Similarity of two arrays as sets, with one more in the denominator; null sides are empty."""
    a, b = (F.coalesce(x if isinstance(x, Column) else F.col(x), F.array()) for x in (a, b))
    return F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + 1)


def ratio100(a: Column, b: Column) -> Column:
    """a / b in hundredths, in single precision and truncated; NO_RATIO for b = 0."""
    return F.when(b == 0, F.lit(NO_RATIO)).otherwise(times(single_divide(a, b), 100))


def single_divide(a: Column, b: Column) -> Column:
    """a / b in single precision: the engine divides in double precision, which rounds to the same."""
    return (a.cast("float") / b.cast("float")).cast("float")


def times(a: Column, factor: int) -> Column:
    """a * factor in single precision, truncated."""
    return (a.cast("float") * F.lit(factor).cast("float")).cast("int")


def action_letter(action: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ACTION_LETTERS.items() for x in pair])
    return F.try_element_at(table, action if isinstance(action, Column) else F.col(action))


def leading_int(text: Column | str) -> Column:
    """The integer that a text starts with, null if it starts with none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def is_numeric(text: Column | str) -> Column:
    return F.coalesce((text if isinstance(text, Column) else F.col(text)).rlike("^[0-9]+$"), F.lit(False))


def sorted_key(items: Column | str) -> Column:
    """A key of a list whatever its order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x.cast("string")), "|")


def list_key(items: Column | str) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), "|")


def sha1_bucket(text: Column | str, digits: int = 8) -> Column:
    """SHA-1 of a text, as the integer of its hexadecimal digits modulo 10**digits (digits <= 8)."""
    h, m = F.sha1(text), 10**digits
    out = F.lit(0).cast("bigint")
    for i in range(0, 40, 5):
        out = (out * (16**5 % m) + F.conv(F.substring(h, i + 1, 5), 16, 10).cast("bigint")) % m
    return out


def lookup(key: Column | str, table: dict, default=None) -> Column:
    """The value of *key* in a small fixed table, *default* (null) without one."""
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(names, key if isinstance(key, Column) else F.col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def country_of(city: Column | str) -> Column:
    """What stands behind the last comma of a city, trimmed."""
    return F.trim(F.element_at(F.split(city, ","), -1))


def country_is_platform(city: Column | str, platform: Column | str, codes: dict[str, str]) -> Column:
    """Whether the country of a city has the platform's code; false for countries without one."""
    return F.coalesce(lookup(country_of(city), codes) == (platform if isinstance(platform, Column) else F.col(platform)), F.lit(False)).cast("int")


def local_time(seconds: Column, platform: Column | str, zones: dict[str, str]) -> Column:
    """Epoch seconds as the platform's local time; UTC for platforms without a zone."""
    return F.from_utc_timestamp(F.timestamp_seconds(seconds), lookup(platform, zones, "UTC"))


def sequence_text(groups: Column | str) -> Column:
    """Lists of places as words: BEG 3 4 , 2 END. Place 0 and missing ones are left out."""
    words = F.transform(groups, lambda g: F.array_join(F.transform(F.filter(g, lambda x: x.isNotNull() & (x != 0)), lambda x: x.cast("string")), " "))
    return F.concat_ws(" ", F.lit("BEG"), F.array_join(F.filter(words, lambda w: w != ""), " , "), F.lit("END"))


def numeric_columns(df) -> list[str]:
    """The names of a frame's numeric columns."""
    from pyspark.sql import types as T

    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
