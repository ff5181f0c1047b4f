"""Keyed deterministic draws.

Every random choice in the library (label noise, complementary labels, row
shuffles, splits, special vectors) is a function of ``(seed, purpose, keys)``
only, never of partitioning or task order.  The same value is computable in
plain SQL, which is what makes the random operators checkable.

``draw(seed, purpose, k1, k2, ...)`` = first 8 hex digits of
``md5("seed:purpose:k1:k2...")`` read as an unsigned 32-bit number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 4294967296  # 2**32, number of distinct draw values


def _as_col(k) -> Column:
    if isinstance(k, Column):
        return k.cast("string")
    if isinstance(k, str):
        return F.col(k).cast("string")
    return F.lit(str(k))


def draw_key(seed: int, purpose: str, *keys) -> Column:
    """The string ``seed:purpose:key...`` that is hashed."""
    return F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[_as_col(k) for k in keys])


def shuffle_key(seed: int, purpose: str, *keys) -> Column:
    """Full md5 hex digest; sort by it (then by id) for a keyed shuffle."""
    return F.md5(draw_key(seed, purpose, *keys))


def draw(seed: int, purpose: str, *keys) -> Column:
    """Unsigned 32-bit keyed draw as a bigint column."""
    return F.conv(F.substring(shuffle_key(seed, purpose, *keys), 1, 8), 16, 10).cast("long")


def uniform(seed: int, purpose: str, *keys) -> Column:
    """Keyed draw mapped to [0, 1)."""
    return draw(seed, purpose, *keys) / F.lit(float(DRAW_RANGE))


def draw_mod(seed: int, purpose: str, modulus, *keys) -> Column:
    """``draw(...) % modulus`` (bias at most modulus / 2**32)."""
    m = modulus if isinstance(modulus, Column) else F.lit(int(modulus))
    return F.pmod(draw(seed, purpose, *keys), m.cast("long"))


# ---- SQL (DuckDB dialect) counterparts, used by the oracle queries -------

def sql_draw_key(seed: int, purpose: str, *keys: str) -> str:
    parts = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    prefix = f"'{seed}:{purpose}'"
    return f"({prefix} || ':' || {parts})" if keys else prefix


def sql_draw(seed: int, purpose: str, *keys: str) -> str:
    return f"CAST(('0x' || substr(md5({sql_draw_key(seed, purpose, *keys)}), 1, 8)) AS BIGINT)"


def sql_shuffle_key(seed: int, purpose: str, *keys: str) -> str:
    return f"md5({sql_draw_key(seed, purpose, *keys)})"


def py_draw(seed: int, purpose: str, *keys) -> int:
    """The same draw in plain Python, for driver-side model initialisation."""
    import hashlib

    s = ":".join([str(seed), purpose] + [str(k) for k in keys])
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
