"""Which tokens can meet a set of keys: a filter of fixed size, tested before anything is exploded or shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter; its 128 KB travel with the plan, whatever the number of keys.
BITS = 1 << 20


def _place(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BITS))


def key_bits(keys: DataFrame) -> bytes:
    """The filter of the column `token`: Spark sets the bits byte by byte, at most BITS / 8 rows come to the driver. More keys
    than bits make a filter that admits everything, which costs time but loses nothing."""
    place = _place(F.col("token"))
    byte, bit = F.shiftright(place, 3).cast("int").alias("byte"), F.expr("shiftleft(1, CAST(place % 8 AS INT))")
    rows = keys.where("token is not null").select(place.alias("place"), byte).groupBy("byte").agg(F.bit_or(bit).alias("bits"))
    out = bytearray(BITS // 8)
    for r in rows.collect():
        out[r["byte"]] = r["bits"]
    return bytes(out)


def admitted(tokens: Column, bits: bytes) -> Column:
    """The tokens that may be keys: all that are, and few others."""
    table = F.lit(bytearray(bits))

    def maybe(token: Column) -> Column:
        place = _place(token)
        byte = F.conv(F.hex(F.substring(table, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1

    return F.filter(tokens, maybe)
