"""Deterministic pseudo-random draws from md5(seed|key): independent of
partitioning and retries, and reproducible in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def hash_hex8(key, seed: int = S.SPLIT_SEED, salt: str | None = None) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    parts = [F.lit(f"{seed}|"), k.cast("string")]
    if salt is not None:
        parts += [F.lit(f"|{salt}")]
    return F.substring(F.md5(F.concat(*parts)), 1, 8)


def hash_unit(key, seed: int = S.SPLIT_SEED, salt: str | None = None) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of the digest."""
    return F.conv(hash_hex8(key, seed, salt), 16, 10).cast("double") / 4294967296.0


def is_test_row(key, seed: int = S.SPLIT_SEED, cut_hex: str = S.TEST_FRACTION_HEX) -> Column:
    return hash_hex8(key, seed) < F.lit(cut_hex)


def fold_of(key, seed: int = S.SPLIT_SEED, cuts=S.FOLD_CUTS_HEX) -> Column:
    h = hash_hex8(key, seed)
    expr = None
    for i, cut in enumerate(cuts):
        expr = F.when(h < F.lit(cut), F.lit(i)) if expr is None else expr.when(h < F.lit(cut), F.lit(i))
    return expr.otherwise(F.lit(len(cuts)))
