"""Notices about single reads and repeated work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files that machines write.
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "poetry.lock", "composer.lock", "gemfile.lock", "go.sum", "pipfile.lock", "flake.lock", "bun.lockb")
GENERATED = r"(?i)\.(min\.(js|css)|bundle\.js|map|pb\.go|generated\.\w+)$"
GENERATED_DIRS = ("dist", "build", "node_modules", "vendor", "__generated__", ".next", "target")
BIG_BYTES, HUGE_BYTES, CHARS_PER_TOKEN = 200_000, 1_000_000, 3.6


def reason_for(path: Column) -> Column:
    """Why a file is hardly worth reading whole: `lock file`, `generated`, `build directory`, or null."""
    name = F.lower(F.regexp_extract(path, "[^/]*$", 0))
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, GENERATED_DIRS)))
    return F.when(name.isin(*LOCKFILES), "lock file").when(name.rlike(GENERATED), "generated").when(inside, "build directory")


def bulk_read(reads: DataFrame, path: str, size: str, ranged: Column | None = None, big: int = BIG_BYTES, huge: int = HUGE_BYTES) -> DataFrame:
    """Reads that deserve a notice, with its reason and the estimated tokens; reads of a range never do."""
    notice = F.coalesce(reason_for(F.col(path)), F.when(F.col(size) >= huge, "very large").when(F.col(size) >= big, "large"))
    got = reads.withColumn("notice", notice).withColumn("estimate", F.col(size) / F.lit(CHARS_PER_TOKEN)).where("notice IS NOT NULL")
    return got if ranged is None else got.where(~F.coalesce(ranged, F.lit(False)))
