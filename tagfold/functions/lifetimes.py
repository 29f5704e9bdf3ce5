"""Expiration arithmetic by user-agent class, as columns. Times are epoch seconds; now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The end of time: records with it never expire; as a requested lifetime it asks for the default.
INFINITE = 2_147_483_647

#: Seconds by user-agent class (unknown, bot, warmer, user).
SESSION_DEFAULT = (3_600, 7_200, 86_400, 1_209_600)
SESSION_READ_EXTRA = (30, 60, 120, 1_209_600)
SESSION_FIRST = (30, 60, 120, 600)
SESSION_FIRST_WRITES = (100, 50, 20, 10)
SESSION_RETAIN = (1, 2, 2, 250)
FPC_DEFAULT = (86_400, 172_800, 1_728_000, 5_184_000)
FPC_READ_EXTRA = FPC_DEFAULT
FPC_MAX = (864_000, 2_592_000, 5_184_000, 5_184_000)
FPC_RETAIN = (1, 2, 50, 100)
USER = 3


def by_ua(ua: Column, values: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), ua + 1)


def fpc_expire(mtime: Column, lifetime: Column, ua: Column) -> Column:
    """When a page saved at mtime expires: 0 is never, a negative lifetime (or INFINITE) the default; clipped to the class's most."""
    asked = F.when((lifetime < 0) | (lifetime == INFINITE), by_ua(ua, FPC_DEFAULT)).otherwise(lifetime)
    return F.when(lifetime == 0, F.lit(INFINITE).cast("long")).otherwise(mtime + F.least(asked, by_ua(ua, FPC_MAX)))


def fpc_read(expire: Column, ua: Column, now: Column, always: bool) -> Column:
    """Expiration after a read: later by the class's extra, always (LRU modes) or only once expired."""
    later = F.greatest(expire, now + by_ua(ua, FPC_READ_EXTRA))
    return F.when(expire == INFINITE, expire).when(F.lit(always) | (now >= expire), later).otherwise(expire)


def fpc_touch(expire: Column, ua: Column, now: Column, extra: Column) -> Column:
    """Expiration after a touch: what is left and extra, clipped; what never expires stays so."""
    left = F.when(expire.isNull(), F.lit(None)).otherwise(F.least(extra + F.greatest(expire - now, F.lit(0)), by_ua(ua, FPC_MAX)))
    return F.when(expire == INFINITE, expire).otherwise(now + left)


def session_lifetime(ua: Column, lifetime: Column, writes: Column) -> Column:
    """Lifetime of a session at its write number writes (from 0): users may ask for one, others grow from the first to the default."""
    n = F.greatest(by_ua(ua, SESSION_FIRST_WRITES), F.lit(1))
    first, default = by_ua(ua, SESSION_FIRST), by_ua(ua, SESSION_DEFAULT)
    grown = first + F.floor((F.greatest(default, first) - first) * writes / n)
    return F.when(writes == 0, first).when(writes < n, grown).otherwise(default)
