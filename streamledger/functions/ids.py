"""ULIDs as columns: ten base-32 digits of milliseconds and sixteen of entropy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the digits of ULIDs.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
TIME_DIGITS, ENTROPY_DIGITS = 10, 16


def digits_of(number: Column, n: int) -> Column:
    """The last n base-32 digits of a number, highest first."""
    return F.concat(*[F.substring(F.lit(DIGITS), F.shiftright(number, 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in reversed(range(n))])


def ulid_time(ts: Column) -> Column:
    """The time half of the ULID of a timestamp."""
    return digits_of(F.unix_millis(ts), TIME_DIGITS)


def ulid_millis(ulid: Column) -> Column:
    """Milliseconds that a ULID's first ten digits say; null if one is no digit."""
    at = [F.instr(F.lit(DIGITS), F.substring(ulid, k + 1, 1)) - 1 for k in range(TIME_DIGITS)]
    total = reduce(lambda acc, d: acc * F.lit(32) + d, at, F.lit(0).cast("bigint"))
    return F.when((F.char_length(ulid) >= TIME_DIGITS) & reduce(lambda a, d: a & (d >= 0), at, F.lit(True)), total)


def ulid(ts: Column, high: Column, low: Column) -> Column:
    """A ULID of a time and twice 40 bits of entropy."""
    return F.concat(ulid_time(ts), digits_of(high, ENTROPY_DIGITS // 2), digits_of(low, ENTROPY_DIGITS // 2))


def new_ids(prefix: str = "evt") -> Column:
    """Fresh ids. Random: mint them once and store the rows; a second evaluation gives others."""
    bits = lambda: F.shiftrightunsigned(F.xxhash64(F.uuid()), 24)
    return F.concat(F.lit(f"{prefix}_"), ulid(F.current_timestamp(), bits(), bits()))
