"""Semantic versions and constraints as columns.

A version's key is a string that orders like the version: numbers are padded, a release stands over its pre-releases, and
numeric identifiers stand under others. So comparisons, minima and joins stay in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERN = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.\-]+))?(?:\+([0-9A-Za-z.\-]+))?$"


def _number(x: Column) -> Column:
    return F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")


def key(version: Column) -> Column:
    """The ordering string; null for a text that is no version."""
    part = lambda k: F.regexp_extract(version, _PATTERN, k)
    pre = F.transform(F.split(part(4), r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x)))
    tail = F.when(part(4) == "", F.lit("~")).otherwise(F.concat(F.array_join(pre, "!"), F.lit("!")))
    return F.when(version.rlike(_PATTERN), F.concat_ws(".", _number(part(1)), _number(part(2)), _number(part(3)), tail))


def is_prerelease(version: Column) -> Column:
    return F.regexp_extract(version, _PATTERN, 4) != ""


def _of(major: Column, minor: Column, patch: Column, tail: str) -> Column:
    return F.concat_ws(".", _number(major.cast("string")), _number(minor.cast("string")), _number(patch.cast("string")), F.lit(tail))


def bounds(constraint: Column) -> Column:
    """struct(low, low_in, high, high_in) of a constraint: any, a version, ^version, or comparisons joined by spaces.

    An exclusive release as the upper end shuts its own pre-releases out as well."""
    c = F.trim(constraint)
    caret = F.regexp_extract(c, r"^\^(.+)$", 1)
    major, minor = (F.regexp_extract(caret, _PATTERN, k).cast("long") for k in (1, 2))
    next_ = F.when(major == 0, _of(major, minor + 1, F.lit(0), "")).otherwise(_of(major + 1, F.lit(0), F.lit(0), ""))
    low = F.regexp_extract(c, r">=?\s*([0-9][^\s<>=]*)", 1)
    high = F.regexp_extract(c, r"<=?\s*([0-9][^\s<>=]*)", 1)
    high_in = c.rlike(r"<=")
    base = lambda v: F.concat_ws(".", *[_number(F.regexp_extract(v, _PATTERN, k)) for k in (1, 2, 3)])
    same = is_prerelease(low) & (base(low) == base(high))
    top = F.when(high == "", None).when(high_in | is_prerelease(high) | same, key(high)).otherwise(F.concat(base(high), F.lit(".")))
    exact = key(c)
    return F.struct(
        F.when(c == "any", None).when(caret != "", key(caret)).when(exact.isNotNull(), exact).otherwise(key(low)).alias("low"),
        F.when(caret != "", True).when(exact.isNotNull(), True).otherwise(c.rlike(r">=")).alias("low_in"),
        F.when(c == "any", None).when(caret != "", next_).when(exact.isNotNull(), exact).otherwise(top).alias("high"),
        F.when(exact.isNotNull(), True).when(caret != "", False).otherwise(high_in).alias("high_in"),
    )


def allows(b: Column, version_key: Column) -> Column:
    low = b["low"].isNull() | (version_key > b["low"]) | (b["low_in"] & (version_key == b["low"]))
    high = b["high"].isNull() | (version_key < b["high"]) | (b["high_in"] & (version_key == b["high"]))
    return low & high


def overlaps(b: Column, low: str, high: str) -> Column:
    """Whether the constraint allows any version of [low, high), both releases."""
    l, h = (F.concat_ws(".", *[F.lpad(F.lit(x), 20, "0") for x in v.split(".")]) for v in (low, high))
    from_, to = F.concat(l, F.lit(".~")), F.concat(h, F.lit("."))
    return (b["low"].isNull() | (b["low"] < to)) & (b["high"].isNull() | (b["high"] > from_) | (b["high_in"] & (b["high"] == from_)))


def sdk_flags(constraint: Column) -> Column:
    """struct(has, allows_3, allows_2, null_safe) of an SDK constraint; no constraint: all false."""
    b = bounds(constraint)
    has = constraint.isNotNull() & (F.trim(constraint) != "") & (F.trim(constraint) != "any")
    least = F.substring(b["low"], 1, 62)
    f = F.lit(False)
    return F.struct(
        F.coalesce(has, f).alias("has"),
        F.coalesce(has & overlaps(b, "2.9999.0", "3.0.0"), f).alias("before_3"),
        F.coalesce(has & overlaps(b, "2.0.0", "3.0.0"), f).alias("allows_2"),
        F.coalesce(has & (least >= ".".join(x.rjust(20, "0") for x in ("2", "12", "0"))), f).alias("null_safe"),
    )


def widened(constraint: Column) -> Column:
    """A null-safe constraint whose upper end is below 3.0.0 reaches up to 4.0.0."""
    flags = sdk_flags(constraint)
    return F.when(flags["null_safe"] & constraint.rlike(r"<\s*3\.0\.0\s*$"), F.regexp_replace(constraint, r"<\s*3\.0\.0\s*$", "<4.0.0")).otherwise(constraint)


def without_top(constraint: Column) -> Column:
    """A constraint without its upper end."""
    return F.when(constraint.rlike(r"^\s*\^"), F.concat(F.lit(">="), F.regexp_extract(constraint, r"\^(.+)$", 1))).otherwise(F.trim(F.regexp_replace(constraint, r"<=?\s*[0-9][^\s]*", "")))


def age_days(published: Column, as_of: Column) -> Column:
    """Whole days since; a missing date counts as the epoch."""
    then = F.coalesce(F.unix_timestamp(published), F.lit(0))
    return F.floor((F.unix_timestamp(as_of) - then) / 86400).cast("long")
