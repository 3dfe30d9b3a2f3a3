"""Points in ranges, the narrowest first: an equality join on bins instead of a comparison of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def narrowest_range(points: DataFrame, ranges: DataFrame, key: str, value: str, carry: list[str], bin_bits: int = 16) -> DataFrame:
    """(key, value, carry...) of the points that lie in a range of ``ranges`` (lo, hi, carry...; both ends
    inside): the range with the fewest values, of equal ones the first by (lo, carry).

    Values and ranges meet on bins of ``2 ** bin_bits`` values: a point is in one bin, a range in every bin it
    touches (at most 2 ** (32 - bin_bits) for 32-bit values). A crowded bin is a join key that AQE can
    split; the choice among nested ranges is a partial aggregate per point. ``key`` identifies a point."""
    low, high = (F.shiftright(F.col(c).cast("long"), bin_bits) for c in ("lo", "hi"))
    binned = ranges.filter(F.col("lo") <= F.col("hi")).select("lo", "hi", *carry, F.explode(F.sequence(low, high)).alias("_bin"))
    own = points.filter(F.col(value).isNotNull()).select(key, value).withColumn("_bin", F.shiftright(F.col(value).cast("long"), bin_bits))
    met = own.join(binned, "_bin").filter(F.col(value).between(F.col("lo"), F.col("hi")))
    best = F.min(F.struct((F.col("hi") - F.col("lo")).alias("width"), "lo", *carry)).alias("_best")
    return met.groupBy(key, value).agg(best).select(key, value, *[F.col(f"_best.{c}").alias(c) for c in carry])


def ipv4_number(ip: Column) -> Column:
    """The 32-bit number of a dotted IPv4 address, null if it is none."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.cast("int"))
    good = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255)
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p))


def cidr_range(cidr: Column) -> tuple[Column, Column]:
    """(first, last) address number of ``a.b.c.d/len``, nulls if it is none; host bits are ignored."""
    bits = F.regexp_extract(cidr, r"/(\d{1,2})$", 1).try_cast("int")
    size = F.when(bits.between(0, 32), F.pow(F.lit(2.0), 32 - bits).cast("long"))
    number = ipv4_number(F.regexp_replace(cidr, r"/\d+$", ""))
    first = number - number % size
    return first, first + size - 1
