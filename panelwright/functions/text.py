"""Cleaning of codes, numbers, names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic capitals that look like Latin section letters, and their Latin twins.
LOOKALIKES = ("АВЕКМНОРСТХ", "ABEKMHOPCTX")


def norm_code(x: Column, width: int = 8, full: int = 11) -> Column:
    """Digits only; a code of ``full`` digits keeps its first ``width``; shorter ones are padded, longer ones kept."""
    d = F.regexp_replace(x, r"\D", "")
    d = F.when(F.length(d) == full, F.substring(d, 1, width)).otherwise(d)
    return F.when(F.length(d) < width, F.lpad(d, width, "0")).otherwise(d)


def is_summary_code(code: Column) -> Column:
    """Codes of totals: characters 4 and 5 are ``00`` or the last three aren't ``000``."""
    return (F.substring(code, 4, 2) == "00") | (F.substring(code, 6, 3) != "000")


def parse_number(x: Column) -> Column:
    """A number with a decimal comma and blanks between thousands; null if it is none."""
    return F.regexp_replace(F.translate(x, ",", "."), r"[\s ]", "").try_cast("double")


def section_letter(label: Column) -> Column:
    """The section's Latin capital at the start of a label, Cyrillic twins included; null if there is none."""
    m = F.regexp_extract(F.upper(label), rf"^(?:РАЗДЕЛ\s+)?([A-Z{LOOKALIKES[0]}])(?![\p{{L}}])", 1)
    return F.nullif(F.translate(m, *LOOKALIKES), F.lit(""))


def name_key(name: Column) -> Column:
    """Lower case, without parenthesised parts and anything but letters."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), "ё", "е"), r"\(.*?\)", ""), r"[^\p{L}]", "")


def short_name(name: Column) -> Column:
    """Without a last parenthesis; the first letter is lowered unless the second is a capital."""
    s = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))
    second = F.substring(s, 2, 1)
    capital = (second == F.upper(second)) & (second != F.lower(second))
    return F.when(capital, s).otherwise(F.concat(F.lower(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s))))


def cluster_code(label: Column) -> Column:
    return F.coalesce(F.concat(F.lit("K"), (label + 1).cast("string")), F.lit("—"))


def union_flags(*flags: Column) -> Column:
    """Sorted distinct flags of ``;``-joined sets."""
    both = F.concat(*[F.split(F.coalesce(f, F.lit("")), ";") for f in flags])
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(both, F.trim), lambda x: x != ""))), ";")


def fingerprint(ids: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the sorted ids, joined by commas."""
    return F.substring(F.sha1(F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",")), 1, 12)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """``cos1`` and ``cos2``: the cosines of the latitudes, where they are known."""
    cos1, cos2 = F.cos(F.radians(lat1)) if cos1 is None else cos1, F.cos(F.radians(lat2)) if cos2 is None else cos2
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + cos1 * cos2 * F.pow(F.sin(dlon), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def rounded(c: Column, digits: int) -> Column:
    """``c`` to ``digits`` places, halves up, as DuckDB does it: for columns of many rows, since ``round`` goes by way of a decimal for each."""
    return F.when((c >= 0) & (c < 1e9), F.floor(c * 10.0**digits + 0.5) / 10.0**digits).otherwise(F.round(c, digits))


def default_periods(y0: Column, y1: Column, n: int) -> Column:
    """``n`` evenly spaced years from ``y0`` to ``y1``, halves to the even year, without repeats."""
    step = (y1 - y0) / (n - 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(y0 + i * step).cast("long")))


def trajectory(labels: Column) -> Column:
    """How the known labels of consecutive periods move: towards 0 is up."""
    known = F.filter(labels, lambda x: x.isNotNull())
    pairs = F.zip_with(F.slice(known, 1, F.size(known) - 1), F.slice(known, 2, F.size(known) - 1), lambda a, b: b - a)
    few = F.size(known) < 2
    return (
        F.when(few, "no data")
        .when(F.forall(F.when(few, F.array(F.lit(0).cast("long"))).otherwise(pairs), lambda d: d == 0), "stable")
        .when(F.forall(F.when(few, F.array(F.lit(0).cast("long"))).otherwise(pairs), lambda d: d <= 0), "up")
        .when(F.forall(F.when(few, F.array(F.lit(0).cast("long"))).otherwise(pairs), lambda d: d >= 0), "down")
        .otherwise("mixed")
    )
