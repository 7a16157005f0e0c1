"""Reproducible random order: every shuffle is an order by a seeded hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(seed: int | str, columns: Sequence[str]) -> Column:
    """Hex md5 of ``seed|col|col``; recomputable, so lost tasks re-run alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def uniform(hash_hex: Column) -> Column:
    """A number in [0, 1) from the leading 32 bits of a hex hash."""
    return F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def hash_int(hash_hex: Column) -> Column:
    """A number in [0, 2**60) from a hex hash."""
    return F.conv(F.substring(hash_hex, 1, 15), 16, 10).cast("bigint")
