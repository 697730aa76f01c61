"""Reproducible pseudo-random draws: a hash of the row's key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_hash(key: Column, seed: int | str) -> Column:
    """Hex digest that depends on the key and the seed only."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_draw(digest: Column, n: Column | int) -> Column:
    """Integer in ``[0, n)`` from a digest; NULL when there is nothing to draw from."""
    size = F.lit(n) if isinstance(n, int) else n
    wide = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return F.pmod(wide, F.nullif(size.cast("bigint"), F.lit(0).cast("bigint")))
