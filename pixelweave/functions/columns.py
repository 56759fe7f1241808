"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 2147483647


def lookup(values: dict, key: Column, kind: str) -> Column:
    """A constant map over the chromosome table, which is bounded by an assembly's chromosomes."""
    if not values:
        return F.lit(None).cast(kind)
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))]), key)


def local_bin(position: Column, binsize: int, zero_based: bool = False) -> Column:
    """Bin within the chromosome; positions are 1-based unless said otherwise, and none lies before bin 0."""
    return F.floor(F.greatest(position - (0 if zero_based else 1), F.lit(0).cast("long")) / F.lit(binsize)).cast("long")


def saturated(total: Column) -> Column:
    """A count as 32 bits; larger sums stay at the largest."""
    return F.least(total, F.lit(MOST).cast("long")).cast("int")


def coarse(bin_id: Column, offset: Column, coarse_offset: Column, factor: int) -> Column:
    """The bin of a coarser layout; chromosomes never share one."""
    return (coarse_offset + F.floor((bin_id - offset) / F.lit(factor))).cast("long")
