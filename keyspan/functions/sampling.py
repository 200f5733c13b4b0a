"""Repeatable sampling: a row's fate depends on its id alone, not on partitions, order or retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_RANGE = 2**32
# Where in the 32 hexadecimal digits of the md5 the draw for a purpose begins.
PURPOSES = {"sample": 1, "split": 9, "fold": 17, "part": 25}


def _as_list(row_id: str | list[str]) -> list[str]:
    return [row_id] if isinstance(row_id, str) else list(row_id)


def id_hash(row_id: str | list[str], purpose: str, seed: int) -> Column:
    """32 bits of the md5 of seed and id. Every purpose has bits of its own, so their draws are unrelated."""
    text = F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in _as_list(row_id)])
    return F.conv(F.substring(F.md5(text), PURPOSES[purpose], 8), 16, 10).cast("bigint")


def below(hashed: Column, fraction: float) -> Column:
    """Whether a hash from ``id_hash`` falls into the first ``fraction`` of their range."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction {fraction} is outside [0, 1]")
    return hashed < F.lit(fraction * HASH_RANGE)


def in_fraction(row_id: str | list[str], fraction: float, purpose: str, seed: int) -> Column:
    return below(id_hash(row_id, purpose, seed), fraction)


def sample_fraction(df: DataFrame, fraction: float, row_id: str | list[str], seed: int = 1) -> DataFrame:
    """A share of the rows without replacement; a larger share contains every smaller one."""
    return df.where(in_fraction(row_id, fraction, "sample", seed))


def split(
    df: DataFrame, fraction: float, row_id: str | list[str], seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Training rows (``fraction`` of them) and test rows (all others)."""
    train = in_fraction(row_id, fraction, "split", seed)
    return df.where(train), df.where(~train)


def nth_fold(hashed: Column, folds: int) -> Column:
    return (hashed % F.lit(folds)).cast("int")


def fold_of(row_id: str | list[str], folds: int, seed: int = 1) -> Column:
    """Cross-validation fold 0..folds-1 of a row."""
    return nth_fold(id_hash(row_id, "fold", seed), folds)
