"""Scalar normalisation: quantities, annotations, identifiers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest annotation key and value.
LONGEST = 1024
# fixed values: suffixes of quantities
SUFFIXES = {"n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18, "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50, "Ei": 2.0**60}


def parse_quantity(quantity: Column, milli: bool = False) -> Column:
    """A quantity such as 100m, 1.5 or 2Gi as whole units, or thousandths, rounded up; null and unreadable ones are 0."""
    pattern = r"^([+-]?[0-9]*\.?[0-9]+)(?:[eE]([+-]?[0-9]+))?(Ki|Mi|Gi|Ti|Pi|Ei|n|u|m|k|M|G|T|P|E)?$"
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), F.regexp_extract(quantity, pattern, 3))
    number = F.try_to_number(F.regexp_extract(quantity, pattern, 1), F.lit("S999999999999999999.999999999")).cast("double")
    exponent = F.when(F.regexp_extract(quantity, pattern, 2) != "", F.pow(F.lit(10.0), F.regexp_extract(quantity, pattern, 2).try_cast("double"))).otherwise(1.0)
    # the product is exact to 15 digits; what lies closer to a whole number than that is it
    value = F.round(F.coalesce(F.regexp_extract(quantity, pattern, 1).try_cast("double"), number) * exponent * factor * (1000.0 if milli else 1.0), 6)
    return F.coalesce(F.ceil(value), F.lit(0)).cast("long")


def job_resources(containers: Column, resource: str, milli: bool = False) -> Column:
    """Sum over containers (array of map of quantities) of one resource; missing ones are 0."""
    return F.aggregate(containers, F.lit(0).cast("long"), lambda acc, c: acc + parse_quantity(F.try_element_at(c, F.lit(resource)), milli))


def clean_annotations(annotations: Column, prefix: str, blocklist: Iterable[str]) -> Column:
    """Without blocked keys (whatever their case), the prefix cut off keys that have it, no NUL, at most LONGEST characters."""
    blocked = [b.lower() for b in blocklist]
    kept = F.map_filter(annotations, lambda k, v: ~F.lower(k).isin(blocked))
    tidy = lambda c: F.substring(F.regexp_replace(c, "\\x00", ""), 1, LONGEST)
    entries = F.transform(F.map_entries(kept), lambda e: F.struct(tidy(F.when(e["key"].startswith(prefix), F.substring(e["key"], F.lit(len(prefix) + 1), F.length(e["key"]))).otherwise(e["key"])).alias("key"), tidy(e["value"]).alias("value")))
    # two keys may become one: the later wins
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)
