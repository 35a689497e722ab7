"""String hash used to spread text keys over shards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Multiplier and mask of the hash.
HASH33_FACTOR = 33
HASH33_MASK = 2147483647


def hash33(c: Column, seed: int = 0) -> Column:
    """Fold code points into ``h*33 + c``, kept to 31 bits.

    Masking at each step equals masking once at the end, since the mask is a
    power of two minus one, and keeps the accumulator inside a BIGINT.
    """
    chars = F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda ch: ch != "")
    step = lambda h, ch: (h * HASH33_FACTOR + F.ascii(ch)).bitwiseAND(F.lit(HASH33_MASK).cast("bigint"))
    return F.aggregate(chars, F.lit(seed).cast("bigint"), step)
