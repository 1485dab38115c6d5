"""Ids and orders from content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, members: Column) -> Column:
    """``prefix_`` and 16 hex digits of the digest of the sorted members, joined by a null character."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.array_join(F.array_sort(members), "\x00"), 256), 1, 16))


def rank_hash(seed: int, namespace: str, key: Column) -> Column:
    """A pseudo-random order that depends on nothing but seed, namespace and key."""
    return F.sha2(F.concat(F.lit(f"{seed}|{namespace}|"), key), 256)


def discovery_hash(seed: int, key: Column) -> Column:
    """The order of the discovery sample; its separator differs from :func:`rank_hash`."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def row_digest(*columns: Column) -> Column:
    """A digest of several values; null differs from empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("\x01")) for c in columns]), "\x00"), 256)
