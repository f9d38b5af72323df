"""Seeded, partition-independent randomness from row keys.

A draw depends only on the key and the seed, so a retried task or another
partitioning gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13  # 52 bits, exact in a double


def key_digest(*parts) -> Column:
    """Hex digest of the parts joined by '|'; sorting by it shuffles the keys."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def uniform(*parts) -> Column:
    """Uniform draw in (0, 1)."""
    bits = F.conv(F.substring(key_digest(*parts), 1, HEX_DIGITS), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(16**HEX_DIGITS)


def normal(*parts) -> Column:
    """Standard normal draw (Box-Muller on two uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, "u")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "v"))
