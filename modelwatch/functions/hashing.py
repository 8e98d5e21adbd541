"""Seeded pseudo-randomness as a pure function of row keys.

``rand(seed)`` depends on how rows are laid out over partitions, so a retried or repartitioned job would
draw other numbers. Hashing the row key gives each row the same draw wherever and whenever it is computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
UNIT_SCALE = float(1 << (4 * HEX_DIGITS))


def hash_bits(seed: int | str, *keys: str | Column) -> Column:
    """A 52-bit non-negative integer from the keys and the seed."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("bigint")


def hash_unit(seed: int | str, *keys: str | Column) -> Column:
    """A uniform draw in [0, 1)."""
    return hash_bits(seed, *keys).cast("double") / F.lit(UNIT_SCALE)


def hash_normal(seed: int | str, *keys: str | Column) -> Column:
    """A standard normal draw: Box-Muller over two independent hashed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - hash_unit(f"{seed}r", *keys)))
    return radius * F.cos(F.lit(6.283185307179586) * hash_unit(f"{seed}a", *keys))
