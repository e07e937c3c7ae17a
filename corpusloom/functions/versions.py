"""Version tags in order, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pre-releases in their order.
STAGES = ["a", "b", "rc"]
#: v1.2.3, with any number of parts, a pre-release (a, alpha, b, beta, c, rc, pre, preview with a number or none) and a post-release.
_TAG = r"(?i)^v*([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(a|alpha|b|beta|c|rc|pre|preview)[-_.]?([0-9]*))?(?:[-_.]?(?:post|rev|r)[-_.]?([0-9]+))?$"


def version_key(tag: Column) -> Column:
    """An array of numbers that sorts as versions do; null for what is none.

    Parts that are 0 at the end don't count: 1.0 is 1. A pre-release comes before its release, a post-release behind it.
    Each part goes in as itself plus one, so that a longer number sorts behind its beginning and the marks below 1 behind that.
    """
    tag = F.trim(tag)
    part = lambda n: F.regexp_extract(tag, _TAG, n)
    numbers = F.regexp_replace(part(1), r"(?:\.0+)+$", "")
    release = F.transform(F.split(numbers, r"\."), lambda x: x.cast("decimal(20,0)") + 1)
    stage = F.lower(part(2))
    of = F.when(stage == "", 3).when(stage.isin("a", "alpha"), 0).when(stage.isin("b", "beta"), 1).otherwise(2)
    whole = lambda x: F.coalesce(F.nullif(x, F.lit("")).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    # after the parts: 0 where the release ends, then the stage, its number, and the post-release plus one
    post = F.when(part(4) == "", F.lit(0).cast("decimal(20,0)")).otherwise(whole(part(4)) + 1)
    tail = F.array(F.lit(0).cast("decimal(20,0)"), of.cast("decimal(20,0)"), whole(part(3)), post)
    return F.when(tag.rlike(_TAG), F.concat(release, tail).cast("array<decimal(21,0)>"))


def newest(tag: Column) -> Column:
    """The aggregate that gives the tag of the highest version; null if there is none."""
    return F.max_by(tag, version_key(tag))


def update_message(current: Column, latest: Column) -> Column:
    """What is to be said of a version beside the newest one."""
    plain = lambda x: F.regexp_replace(x, "^v+", "")
    return F.when(version_key(latest).isNull(), F.concat(F.lit("no version tags found, current is v"), plain(current))).when(version_key(current) >= version_key(latest), F.concat(F.lit("up to date: v"), plain(current))).otherwise(F.concat(F.lit("update available: v"), plain(current), F.lit(" to v"), plain(latest)))
