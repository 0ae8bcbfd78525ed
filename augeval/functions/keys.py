"""Entity identity: exact key, rotation/reversal-invariant cycle key, either-key id.

Two rows are the same entity when they agree on EITHER key. The cycle key is a function of the exact
key, so grouping or equi-joining on ``entity_id`` (cycle key when present, else exact key, with prefixes
that keep the two name spaces apart) is the either-key rule as ONE equi-join, never an OR join.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# A number is optional sign, digits with an optional fraction (or a bare fraction),
# optional exponent, surrounding blanks allowed. Anything else is not numeric.
NUMERIC_PATTERN = r"^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_or_null(c) -> Column:
    """Text to double, null when not a plain decimal number; NaN never appears (the pattern rejects it)."""
    s = _col(c).cast("string")
    return F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))


def exact_key(c) -> Column:
    """Normal form of an entity spelling: blanks collapsed, trimmed, lower case; null when empty."""
    s = F.lower(F.trim(F.regexp_replace(_col(c), r"\s+", " ")))
    return F.when(s != "", s)


def tokens(c) -> Column:
    """Token list of an exact key."""
    return F.split(_col(c), " ")


def _least_rotation(t: list[bytes]) -> bytes:
    """The least rotation of a token list, joined, in linear time.

    Two candidate starts i < j (or j < i) are compared k tokens on; the one with the greater token loses, with every start up
    to that token. Every step raises i + j + k, which ends below 3 n. The order of joined texts is the order of tokens with
    their blank, so the list holds those."""
    n, i, j, k = len(t), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = t[(i + k) % n], t[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i = i + k + 2 if i + k + 1 == j else i + k + 1
        else:
            j = j + k + 2 if j + k + 1 == i else j + k + 1
        k = 0
    at = min(i, j)
    return b"".join(t[at:] + t[:at])


@lru_cache(maxsize=1 << 16)   # a worker sees many rows of a spelling
def _cycle_key(key: str | None) -> str | None:
    if key is None or "." in key:
        return None
    t = [w + b" " for w in key.encode().split(b" ")]
    if len(t) < 3:
        return None
    return min(_least_rotation(t), _least_rotation(t[::-1])).rstrip(b" ").decode()


def _cycle_keys(keys: pa.Array) -> pa.Array:
    return pa.array([_cycle_key(k) for k in keys.to_pylist()], pa.string())


def add_cycle_key(df, exact_col: str = "exact_key", out: str = "alt_key"):
    """A key equal for every cut and direction of a cyclic token sequence, as a column of ``df``.

    The smallest text over all rotations of the tokens and of the reversed tokens. Null for fewer than three
    tokens (a two-token cycle has one cut) and for several fragments ('.' in the key). Periods are not reduced.
    Each direction's least rotation is found in linear time; only these two are spelled out."""
    return df.withColumn(out, F.arrow_udf(_cycle_keys, "string")(F.col(exact_col)))


def entity_id(exact, alt) -> Column:
    """Either-key group id: 'R:' + cycle key when it exists, else 'E:' + exact key."""
    return F.coalesce(F.concat(F.lit("R:"), _col(alt)), F.concat(F.lit("E:"), _col(exact)))


def md5_bucket(c, buckets: int = 100) -> Column:
    """Stable bucket from the first 8 hex digits of md5 (the same number in any engine)."""
    return (F.conv(F.substring(F.md5(_col(c).cast("string")), 1, 8), 16, 10).cast("bigint") % buckets)


def seeded_hash(seed: int, *cols) -> Column:
    """Seeded, engine-independent order key: md5 of 'seed|value|...' as text."""
    parts = [F.lit(str(seed))] + [_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


KeyFn = Callable[[Column], Column]


def with_keys(df, raw_col: str, key_fn: KeyFn = exact_key, alt_fn: KeyFn | None = None):
    """Add exact_key, alt_key and entity_id once (reused by every later step). ``key_fn`` / ``alt_fn`` are the
    plug points, e.g. a vectorized pandas_udf wrapping a domain canonicalizer; the default alt key is the cycle key."""
    df = df.withColumn("exact_key", key_fn(F.col(raw_col)))
    df = add_cycle_key(df) if alt_fn is None else df.withColumn("alt_key", alt_fn(F.col("exact_key")))
    return df.withColumn("entity_id", entity_id("exact_key", "alt_key"))
