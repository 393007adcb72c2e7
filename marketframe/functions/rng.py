"""Counter-based random numbers.

A draw is a pure function of (tag, seed, counters), so results do not depend on partitioning,
task order or retries. One md5 gives four independent 32-bit draws (``slot`` 0 to 3).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(tag: str, seed: int, *counters: Column, slot: int = 0) -> Column:
    """A double in [0, 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(tag), F.lit(str(seed)), *[c.cast("string") for c in counters]))
    return F.conv(F.substring(digest, 1 + 8 * slot, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(u: Column, n: Column) -> Column:
    """Map a uniform draw to an index in [0, n)."""
    return F.floor(u * n).cast("long")
