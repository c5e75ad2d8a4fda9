"""Import resolution and one-hop reverse dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the path of a test looks like.
TEST_PATHS = (r"(^|/)tests?/", r"(^|/)spec/", r"(^|/)__tests__/", r"(^|/)test_[^/]+$", r"_test\.[a-z]+$", r"\.test\.[a-z]+$", r"\.spec\.[a-z]+$", r"Tests?\.[a-z]+$", r"Test\.java$")
MAX_ENTRIES, MAX_USED_BY, MAX_TESTS = 120, 6, 3


def is_test(path: Column) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in TEST_PATHS))


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def normal_path(path: Column) -> Column:
    """A relative path without `.` and resolved `..` steps."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    pop = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), pop), "/")


def candidates(imports: DataFrame) -> DataFrame:
    """(importer, name, tier, key, exact) for each reading of imports(importer, name), in the order they are tried.

    1, 2: a path, relative to the importer's folder or to the root; 3: dots,
    `::` and backslashes as folders; 4: the last part as a file's stem. Tiers 1
    to 3 take an exact path, or else a unique ending.
    """
    name = F.col("name")
    like_path = F.startswith(name, F.lit(".")) | F.contains(name, F.lit("/"))
    folder = _parent(F.col("importer"))
    relative = normal_path(F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat_ws("/", folder, name)))
    dotted = F.replace(F.replace(name, F.lit("::"), F.lit(".")), F.lit("\\"), F.lit("."))
    readings = F.array(
        F.struct(F.lit(1).alias("tier"), F.when(like_path, relative).alias("key")),
        F.struct(F.lit(2).alias("tier"), F.when(like_path, normal_path(name)).alias("key")),
        F.struct(F.lit(3).alias("tier"), F.btrim(F.replace(dotted, F.lit("."), F.lit("/")), F.lit("/")).alias("key")),
        F.struct(F.lit(4).alias("tier"), F.regexp_extract(dotted, r"[^./]*$", 0).alias("key")),
    )
    each = imports.where("name IS NOT NULL AND name <> ''").select("importer", "name", F.explode(readings).alias("r")).select("importer", "name", "r.tier", "r.key").where("key IS NOT NULL AND key <> ''")
    # A path may be written with its file's extension.
    bare = each.where("tier < 3").withColumn("key", _without_extension(F.col("key")))
    return each.unionByName(bare).distinct()


def resolve(paths: DataFrame, imports: DataFrame) -> DataFrame:
    """(importer, name, target) for every import; target is null where nothing, or more than one file, fits.

    Paths are exploded into all their endings once, so that an ending is found by an equi-join; endings and stems that
    several files share are dropped before the join. Files that differ in nothing but their extension share a key and are ambiguous.
    """
    key = paths.select("path").distinct().withColumn("full", _without_extension(F.col("path")))
    parts = F.split("full", "/")
    ends = key.select("path", "full", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))).alias("depth", "key"))
    unique = lambda df: df.groupBy("key").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("key", "path")
    exact = unique(key.select(F.col("full").alias("key"), "path")).withColumn("step", F.lit(0))
    suffix = unique(ends.select("key", "path")).withColumn("step", F.lit(1))
    stems = unique(key.select(F.regexp_extract("full", "[^/]*$", 0).alias("key"), "path"))
    tried = candidates(imports)
    # An exact path counts before any ending of the same reading.
    by_path = tried.where("tier < 4").join(exact.unionByName(suffix), "key").select("importer", "name", "tier", "step", "path")
    by_stem = tried.where("tier = 4").join(stems, "key").select("importer", "name", "tier", F.lit(2).alias("step"), "path")
    best = by_path.unionByName(by_stem).groupBy("importer", "name").agg(F.min_by("path", F.struct("tier", "step", "path")).alias("target"))
    return imports.select("importer", "name").distinct().join(best, ["importer", "name"], "left")


def reverse_edges(edges: DataFrame, test: Column) -> DataFrame:
    """(target, used_by, tests) from edges(importer, target): sorted, distinct, without self edges and unresolved ones."""
    found = edges.where("target IS NOT NULL AND target <> importer").select("importer", "target", test.alias("test")).distinct()
    return found.groupBy("target").agg(
        F.sort_array(F.collect_list(F.when(~F.col("test"), F.col("importer")))).alias("used_by"),
        F.sort_array(F.collect_list(F.when(F.col("test"), F.col("importer")))).alias("tests"),
    )


def ranked(impact: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """The targets with most dependents, then most tests, then by path, with capped lists and full counts."""
    n, m = F.size("used_by"), F.size("tests")
    return impact.select("target", n.alias("n_used_by"), m.alias("n_tests"), F.slice("used_by", 1, MAX_USED_BY).alias("used_by"), F.slice("tests", 1, MAX_TESTS).alias("tests")).orderBy(F.desc("n_used_by"), F.desc("n_tests"), "target").limit(most)


def outside_nested(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """paths without those below a folder of owners(owner): ancestors are exploded and met by an equi-join."""
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("owner"))
    inside = above.join(owners.select("owner").distinct(), "owner", "left_semi").select("path").distinct()
    return paths.join(inside, "path", "left_anti")
