"""Random numbers that a key fixes: the same on every engine, in every run, and for every number of tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(digest: Column, nth: int) -> Column:
    """The nth number between 0 and 1, both excluded, of a hexadecimal digest (eight digits each)."""
    return (F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)


def gaussian(*key) -> Column:
    """A standard normal number for a key of strings and numbers, by the MD5 of its parts joined by '|'."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]))
    return F.sqrt(-2 * F.log(uniform(digest, 0))) * F.cos(2 * math.pi * uniform(digest, 1))
