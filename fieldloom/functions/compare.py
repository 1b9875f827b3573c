"""Comparison operators as columns: numeric, string, bit flags, and angles by dot product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("==", "!=", ">=", "<=", ">", "<", "~=", "!~=")
STRING = ("==", "!=", "len==", "len!=", "len>=", "len<=", "len>", "len<", "locale>", "locale<", "contains", "startswith", "endswith")
BITS = ("any", "all", "strict", "none_any", "none_all")


def col(x) -> Column:
    """A column name or a Column as a Column; anything else as a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def numeric(a, op: str, b, tolerance: float = 1e-3) -> Column:
    """One of the 8 numeric comparisons; near equality is |a - b| <= tolerance."""
    a, b = col(a), col(b)
    match op:
        case "==":
            return a == b
        case "!=":
            return a != b
        case ">=":
            return a >= b
        case "<=":
            return a <= b
        case ">":
            return a > b
        case "<":
            return a < b
        case "~=":
            return F.abs(a - b) <= tolerance
        case "!~=":
            return F.abs(a - b) > tolerance
    raise ValueError(f"no numeric comparison {op!r}")


def string(a, op: str, b, case_sensitive: bool = True) -> Column:
    """One of the 13 string comparisons. Six compare lengths, two compare lexicographically (by code point)."""
    a, b = col(a), b if isinstance(b, Column) else F.lit(b)
    if not case_sensitive:
        a, b = F.lower(a), F.lower(b)
    if op.startswith("len"):
        return numeric(F.length(a), op[3:], F.length(b))
    match op:
        case "==":
            return a == b
        case "!=":
            return a != b
        case "locale>":
            return a > b
        case "locale<":
            return a < b
        case "contains":
            return F.contains(a, b)
        case "startswith":
            return F.startswith(a, b)
        case "endswith":
            return F.endswith(a, b)
    raise ValueError(f"no string comparison {op!r}")


def bits(value, mode: str, mask) -> Column:
    """One of the 5 bit flag comparisons of a value with a mask."""
    value, mask = col(value), col(mask)
    both = value.bitwiseAND(mask)
    match mode:
        case "any":
            return both != 0
        case "all":
            return both == mask
        case "strict":
            return value == mask
        case "none_any":
            return both == 0
        case "none_all":
            return both != mask
    raise ValueError(f"no bit comparison {mode!r}")


def bit_operation(value, op: str, mask) -> Column:
    """set, and, or, not (clears the mask's bits) or xor."""
    value, mask = col(value), col(mask)
    match op:
        case "set":
            return mask
        case "and":
            return value.bitwiseAND(mask)
        case "or":
            return value.bitwiseOR(mask)
        case "not":
            return value.bitwiseAND(F.bitwise_not(mask))
        case "xor":
            return value.bitwiseXOR(mask)
    raise ValueError(f"no bit operation {op!r}")


def bitmask(positions) -> int:
    """The 64-bit signed value with these bits set."""
    value = reduce(lambda acc, p: acc | (1 << p), positions, 0)
    return value - (1 << 64) if value >= 1 << 63 else value


def flags(conditions: list) -> Column:
    """A mask whose bit i is set where conditions[i] holds; null is false."""
    parts = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(conditions)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts, F.lit(0).cast("long"))


def all_of(*conditions) -> Column:
    """A stack of filters: true when all hold; an empty stack passes."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def group(mode: str, *conditions, invert: bool = False) -> Column:
    """An AND or OR group of filters, inverted or not."""
    out = all_of(*conditions) if mode == "and" else any_of(*conditions)
    return ~out if invert else out
