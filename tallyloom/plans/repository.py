"""The relations of a repository, built from a table of its files, and the documents rendered from them.

Input is files(path, content) with optional size and repository columns, as the
file_tree source gives them. `parsed` reads every file once, in one map over the
contents, into one long table of declarations; every relation is a selection of
it, joined and aggregated. Each of them takes files, or that table in their place,
so that a caller that asks for several has the contents looked at once only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, plain, redact, text
from ..operators import graph, relational
from ..sources.durable import stored
from ..sources.tree import MAX_BYTES, SKIPPED

NAME = "struct<name:string,doc:string,methods:array<string>>"
SOURCE = f"lang string, chars long, tokens double, lines long, doc string, describable boolean, imports array<string>, funcs array<struct<sig:string,doc:string>>, classes array<{NAME}>, consts array<string>, warn_count int, warn_msg string"
MAX_ROUTES, MAX_ENV, MAX_PER_KIND, MAX_PER_LIST, MAX_TABLES, MAX_CONSTS, MAX_METHODS = 60, 50, 14, 8, 40, 40, 30
ASSET_DIRS = 12
#: Folders that other scans leave out, all below the root.
VENDORED = (".git", "node_modules", "vendor", "__pycache__", ".venv", "dist", "build")
UNDEPLOYED = (".git", "node_modules", "__pycache__", ".venv", "vendor", ".terraform")
UNSTORED = (".git", "node_modules", "__pycache__", ".venv", "vendor", ".terraform", "dist")
# Build manifests, which are neither source nor stored material.
BUILD_SUFFIXES = (".csproj", ".fsproj", ".vbproj", ".sln", ".props", ".targets", ".sbt", ".gradle", ".mod", ".sum", ".cabal", ".nimble", ".gemspec", ".podspec", ".cmake", ".bazel", ".bzl", ".lock")
BUILD_NAMES = ("go.mod", "go.sum", "cargo.toml", "package.json", "pyproject.toml", "setup.cfg", "gemfile", "podfile", "config.ru", "rakefile", "makefile", "cmakelists.txt", "build.gradle", "settings.gradle", "pom.xml", "composer.json", "mix.exs", "pubspec.yaml", "build.zig", "meson.build", "build", "workspace")
NAMES_ONLY = ("Secret", "SealedSecret")
NOTABLE = (".csv", ".json", ".xml", ".parquet", ".avro", ".sql", ".log", ".md")


def suffix_of(path: Column) -> Column:
    """The lower-case ending of a file's name; a leading dot starts a name, not an ending."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def inside(path: Column, folders: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))


def language_of(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in extract.LANGUAGE.items() for x in pair])[suffix_of(path)]


def own(files: DataFrame) -> DataFrame:
    """Files of this repository itself: those of checkouts inside it are left out everywhere."""
    return files.where("repository IS NULL") if "repository" in files.columns else files


def _decoded(raw) -> str:
    return bytes(raw or b"").decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


#: What `parsed` tells of a file, by what it is looked at for: `source` rows have one struct, the others a name and what belongs to it.
DECLARED = f"what string, path string, rank int, n int, name string, kind string, summary string, items array<string>, source struct<{', '.join(f.replace(' ', ':', 1) for f in SOURCE.split(', '))}>"
SQL_SUFFIXES, YAML_SUFFIXES = (".sql", ".prisma"), (".yaml", ".yml")
MANIFESTS = ("Dockerfile", "Jenkinsfile", "Makefile", "ansible.cfg")


def _looked_at(files: DataFrame) -> dict[str, Column]:
    """For what each file is parsed, by its path and size alone."""
    path, name, suffix = F.col("path"), basename(F.col("path")), suffix_of(F.col("path"))
    size = F.col("size") if "size" in files.columns else F.length("content")
    code = language_of(path).isNotNull() & ~inside(path, SKIPPED)
    kept = ~inside(path, VENDORED)
    env = (name == ".env") | F.startswith(name, F.lit(".env.")) | F.endswith(name, F.lit(".env")) | (name == "env.example")
    schema = inside(F.lower(path), extract.SCHEMA_FOLDERS) | F.lower(name).isin(*extract.SCHEMA_FILES)
    return {
        "source": code & (size <= MAX_BYTES),
        "schema": suffix.isin(*SQL_SUFFIXES) & ~inside(path, (".git", "node_modules", "vendor", "__pycache__")) | code & schema,
        "route": code & language_of(path).isin(*extract.ROUTE_LANGUAGES) | kept & suffix.isin(".proto", ".json", *YAML_SUFFIXES),
        "setting": code | kept & env,
        "ignored": path == ".gitignore",
        "deploy": (suffix.isin(*YAML_SUFFIXES) | name.isin(*MANIFESTS) | F.startswith(name, F.lit("Dockerfile."))) & ~inside(path, UNDEPLOYED),
    }


def _source(lang: str, source: str) -> tuple:
    """The columns of SOURCE. A file that can't be parsed has no symbols."""
    try:
        s = extract.symbols(source, lang)
        described = bool(source.strip()) and not s["empty"]
    except Exception:  # noqa: BLE001  one bad file costs one row's symbols
        s, described = extract.file_symbols(""), False
    funcs = [{"sig": a, "doc": b} for a, b in s["funcs"]]
    classes = [{"name": a, "doc": b, "methods": m} for a, b, m in s["classes"]]
    return lang, len(source), plain.estimate(source), source.count("\n") + 1, s["doc"], described, extract.imports(source, lang), funcs, classes, s["consts"], s["warn_count"], s["warn_msg"]


def _routes(path: str, suffix: str, source: str) -> tuple[int, list[tuple[str, str]]]:
    """The rank of a file among those that declare routes, and its (method, route)s: code, then contracts, then API descriptions."""
    if suffix == ".proto":
        return 1, [("gRPC", f"{service}/{method}") for service, method in extract.rpcs(source)]
    if suffix in (".json", *YAML_SUFFIXES):
        return 2, list(extract.spec_routes(path, source)) if extract.is_spec(path, source) else []
    return 0, list(extract.routes(source, extract.LANGUAGE[suffix]))


def _declared(path: str, lang: str | None, source: str, wanted: set[str]) -> Iterator[tuple]:
    """The rows of DECLARED for one file, but for its path."""
    suffix, name = "." + path.rpartition(".")[2].lower(), path.rpartition("/")[2]
    if "source" in wanted:
        yield "source", 0, 0, None, None, None, None, _source(lang, source)
    if "schema" in wanted:
        for n, (kind, table, summary, columns) in enumerate(extract.declarations(source, suffix)):
            yield kind, int(suffix not in SQL_SUFFIXES), n, table, None, summary, columns, None
    if "route" in wanted:
        rank, found = _routes(path, suffix, source)
        for n, (method, route) in enumerate(found):
            yield "route", rank, n, route, method, None, None, None
    if "setting" in wanted:
        own = extract.is_env_file(name)
        for n, setting in enumerate(extract.settings(source, own)):
            yield "setting", int(not own), n, setting, None, None, None, None
        if name == ".env":
            yield "live", 0, 0, path, None, None, None, None
    if "ignored" in wanted and ".env" in source:
        yield "ignored", 0, 0, ".env", None, None, None, None
    if "deploy" in wanted:
        for group, kind, what in extract.deployment(path, source):
            yield "deploy", 0, 0, what, kind, group, None, None


def parsed(files: DataFrame) -> DataFrame:
    """All declarations (DECLARED) of a repository's files, credentials' files left out; a table of them is returned as it is."""
    if "what" in files.columns:
        return files
    looked = _looked_at(files)
    names = [f.split()[0] for f in SOURCE.split(", ")]

    def run(batches):
        for pdf in batches:
            found = []
            for path, lang, wanted, content in zip(pdf["path"], pdf["lang"], pdf["wanted"], pdf["content"], strict=True):
                for what, rank, n, name, kind, summary, items, source in _declared(path, lang, _decoded(content), set(wanted)):
                    found.append((what, path, rank, n, name, kind, summary, items, source and dict(zip(names, source, strict=True))))
            yield pd.DataFrame(found, columns=["what", "path", "rank", "n", "name", "kind", "summary", "items", "source"])

    wanted = F.array_compact(F.array(*[F.when(condition, what) for what, condition in looked.items()]))
    chosen = own(files).where(~redact.is_blocked(F.col("path"))).select("path", language_of(F.col("path")).alias("lang"), wanted.alias("wanted"), "content")
    return chosen.where(F.size("wanted") > 0).mapInPandas(run, DECLARED)


def sources(files: DataFrame) -> DataFrame:
    """One row per source file: path and the columns of SOURCE. A file that can't be parsed has a row without symbols."""
    return parsed(files).where("what = 'source'").select("path", "source.*")


def language_counts(indexed: DataFrame) -> DataFrame:
    """(lang, files) of source files, most first, by name where counts tie."""
    return indexed.groupBy("lang").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "lang")


def tables(files: DataFrame) -> DataFrame:
    """(name, source, summary, columns) of every table, view and model, by lower-case name."""
    found = parsed(files).where("what IN ('table', 'partition')").withColumn("key", F.lower("name"))
    order = F.struct("rank", F.col("path").alias("source"), "n")
    declared = found.where("what = 'table'").select("key", order.alias("ord"), "name", F.col("path").alias("source"), "summary", F.col("items").alias("columns"))
    merged = relational.fill_in(declared, "key", "ord", "summary", "columns")
    parts = found.where("what = 'partition'").groupBy("key").agg(F.count("*").alias("parts"))
    note = F.concat(F.lit("partitioned, "), F.col("parts").cast("string"), F.lit(" partitions"))
    full = F.when(F.col("parts").isNull(), F.col("summary")).when(F.col("summary") == "", note).otherwise(F.concat(F.col("summary"), F.lit(" ("), note, F.lit(")")))
    return merged.join(parts, "key", "left").select("name", "source", full.alias("summary"), "columns")


def routes(files: DataFrame) -> DataFrame:
    """(method, route, source): code first, then contracts, then API descriptions; the last one that names a route wins."""
    order = F.struct("rank", F.col("path").alias("source"), "n")
    found = parsed(files).where("what = 'route'").select(F.col("kind").alias("method"), F.col("name").alias("route"), F.col("path").alias("source"), "rank", order.alias("ord"))
    http = relational.last_wins(found.where("rank <> 1").drop("rank"), ["method", "route"], "ord")
    # Of contracts, the first file that declares a service is its source.
    grpc = found.where("rank = 1").groupBy("method", "route").agg(F.min("source").alias("source"))
    return http.select("method", "route", "source").unionByName(grpc)


def settings(files: DataFrame) -> DataFrame:
    """(name, source) of every setting: names only, the first file that has it, settings files before code."""
    order = F.struct("rank", F.col("path").alias("source"), "n")
    found = parsed(files).where("what = 'setting'").select("name", F.col("path").alias("source"), order.alias("ord"))
    return relational.first_wins(found, ["name"], "ord").select("name", "source")


def unsafe_settings(files: DataFrame) -> DataFrame:
    """(path) of the live settings files (.env) that the root's .gitignore does not name."""
    found = parsed(files)
    safe = found.where("what = 'ignored'").select("name").distinct()
    return found.where("what = 'live'").select("path", F.lit(".env").alias("name")).join(safe, "name", "left_anti").select("path").distinct()


def deployed(files: DataFrame) -> DataFrame:
    """(group, kind, name, source) of what the manifests deploy; a name once per group and kind, from its first file."""
    found = parsed(files).where("what = 'deploy'").select(F.col("summary").alias("group"), "kind", "name", "path")
    return found.groupBy("group", "kind", "name").agg(F.min("path").alias("source"))


def stored_material(files: DataFrame, indexed: DataFrame, claimed: DataFrame) -> DataFrame:
    """(top, count, bytes, kinds) of what is neither source nor deployment, by top folder; contents are never looked at."""
    size = F.col("size") if "size" in files.columns else F.length("content")
    path = F.col("path")
    hidden = F.exists(F.split(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/"), lambda p: F.startswith(p, F.lit(".")))
    chosen = own(files).where(~inside(path, UNSTORED) & ~hidden & language_of(path).isNull() & ~suffix_of(path).isin(*BUILD_SUFFIXES) & ~F.lower(basename(path)).isin(*BUILD_NAMES))
    if "is_symlink" in files.columns:
        chosen = chosen.where("NOT is_symlink")
    known = indexed.select("path").unionByName(claimed.select("path")).distinct()
    left = relational.not_indexed(chosen.select("path", size.alias("size")), known, "path")
    top = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^([^/]*)/", 1)).otherwise("(root)")
    kind = F.when(suffix_of(path) == "", "(none)").otherwise(suffix_of(path))
    return relational.inventory(left.select(top.alias("top"), kind.alias("kind"), "size"), ["top"], "kind", "size")


def impact(indexed: DataFrame) -> DataFrame:
    """(target, used_by, tests) over the imports of source files."""
    edges = graph.resolve(indexed.select("path"), indexed.select(F.col("path").alias("importer"), F.explode("imports").alias("name")))
    return graph.reverse_edges(edges, graph.is_test(F.col("importer")))


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """A position for rows of a section that is bounded by its cap before this."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def _row(section: str, pos: Column, line: Column) -> list[Column]:
    return [F.lit(section).alias("section"), pos.cast("string").alias("pos"), line.alias("line")]


def _scrubbed(lines: DataFrame) -> DataFrame:
    """Lines with credentials redacted, in one place behind the union: as expressions the patterns would be planned anew for each section."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(line=[x and plain.scrub(x) for x in pdf["line"]])

    return lines.mapInPandas(run, "section string, pos string, line string")


def _code(col: Column) -> Column:
    return F.concat(F.lit("`"), col, F.lit("`"))


def _listed(array: Column, most: int, full: Column | None = None) -> Column:
    more = F.size(array) - most if full is None else full - most
    return F.concat(F.array_join(F.transform(F.slice(array, 1, most), _code), ", "), F.when(more > 0, F.concat(F.lit(" _+"), more.cast("string"), F.lit("_"))).otherwise(""))


def _more(section: str, counted: DataFrame, most: int, where: str) -> DataFrame:
    """A line that says how many of a section's rows are shown, if not all are; counted(pos, total) has where it stands."""
    line = F.concat(F.lit(f"Showing {most} of "), F.col("total").cast("string"), F.lit(where))
    return counted.where(F.col("total") > most).select(*_row(section, F.col("pos"), line))


def index_lines(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(section, pos, line): every line of the repository's index and detail, credentials redacted.

    Lines of a section sort by pos; sections are, in order, index, tables, routes,
    settings, deployment, material, impact, detail. Sections without rows are
    absent. Contents are parsed once, into a table in the shared folder, unless
    that is given as `found`.
    """
    found = stored(parsed(files), "declared") if found is None else found
    src = sources(found)
    counts = F.concat_ws("/", F.when(F.size("funcs") > 0, F.concat(F.size("funcs").cast("string"), F.lit("fn"))), F.when(F.size("classes") > 0, F.concat(F.size("classes").cast("string"), F.lit("cls"))))
    shape = F.concat(F.col("lines").cast("string"), F.lit("L"), F.when(counts != "", F.concat(F.lit(", "), counts)).otherwise(""))
    summary = F.when(F.coalesce("doc", F.lit("")) == "", "—").otherwise(F.col("doc"))
    index = src.select(*_row("index", F.col("path"), F.concat(F.lit("- **"), _code(F.col("path")), F.lit("** ("), shape, F.lit(") — "), summary)))

    t = tables(found)
    desc = F.when(F.col("summary") != "", F.concat(F.lit(" — "), F.col("summary"))).otherwise("")
    if t.limit(MAX_TABLES + 1).count() <= MAX_TABLES:
        table_rows = t.select(*_row("tables", F.lower("name"), F.concat(F.lit("- **"), _code(F.col("name")), F.lit("**"), desc, F.lit("  _("), F.col("source"), F.lit(")_"))))
    else:
        # A large schema is named only; its detail says the rest.
        told = t.select(*_row("tables", F.concat(F.lit("1"), F.lower("name")), F.concat(F.lit("- "), _code(F.col("name")))))
        head = F.concat(F.lit("Names only, of "), F.col("n").cast("string"), F.lit(" tables and models; each is told in the detail."))
        table_rows = t.agg(F.count("*").alias("n")).select(*_row("tables", F.lit("0"), head)).unionByName(told)

    grpc = F.when(F.col("method") == "gRPC", "2").otherwise("1")
    routed = routes(found).withColumn("protocol", grpc)
    kept = relational.top_per_group(routed, ["protocol"], [F.col("route"), F.col("method")], MAX_ROUTES)
    route_more = _more("routes", routed.groupBy(F.col("protocol").alias("pos")).agg(F.count("*").alias("total")), MAX_ROUTES, "; search the sources for the rest.")
    route_rows = kept.select(*_row("routes", F.concat("protocol", F.lpad(F.col("rank").cast("string"), 4, "0")), F.concat(F.lit("- `"), F.rpad("method", 6, " "), F.lit(" "), F.col("route"), F.lit("`  _("), F.col("source"), F.lit(")_"))))

    env = settings(found)
    env_rows = env.orderBy("name").limit(MAX_ENV).select(*_row("settings", F.concat(F.lit("1"), F.col("name")), F.concat(F.lit("- "), _code(F.col("name")))))
    env_more = _more("settings", env.agg(F.lit("0").alias("pos"), F.count("*").alias("total")), MAX_ENV, ".")
    warned = F.concat(F.lit("> "), _code(F.col("path")), F.lit(" is not in .gitignore: such a file mostly holds live credentials, which a commit would publish."))
    env_rows = env_rows.unionByName(unsafe_settings(found).select(*_row("settings", F.concat(F.lit("2"), F.col("path")), warned)))

    d = deployed(found)
    groups = d.groupBy("group", "kind").agg(F.sort_array(F.collect_set("name")).alias("names"))
    cap = lambda n: F.concat(F.lit("- **"), F.when(F.col("group") == "k8s", F.col("kind")).otherwise(F.col("group")), F.lit("** ("), F.size("names").cast("string"), F.lit(") — "), _listed(F.col("names"), n), F.when(F.col("kind").isin(*NAMES_ONLY), "  _(names only)_").otherwise(""))
    place = F.when(F.col("group") == "k8s", F.concat(F.lit("1"), F.lpad((99999 - F.size("names")).cast("string"), 5, "0"), F.col("kind"))).otherwise(F.concat(F.lit("2"), F.col("group")))
    deploy_rows = groups.select(*_row("deployment", place, F.when(F.col("group").isin("k8s", "compose"), cap(MAX_PER_KIND)).otherwise(cap(MAX_PER_LIST))))

    material = stored_material(files, src, d.select(F.col("source").alias("path")).distinct()).orderBy(F.desc("bytes"), "top").limit(ASSET_DIRS)
    kinds = F.array_join(F.transform("kinds", lambda k: F.replace(k, F.lit("="), F.lit(" ×"))), ", ")
    machine = F.filter(F.transform("kinds", lambda k: F.split_part(k, F.lit("="), F.lit(1))), lambda k: k.isin(*NOTABLE))
    tail = F.when(F.size(machine) > 0, F.concat(F.lit("  _(machine-readable: "), F.array_join(machine, ", "), F.lit(")_"))).otherwise("")
    size = text.human_bytes(F.col("bytes"), ("B", "KB", "MB", "GB", "TB"))
    material_rows = _ranked(material, F.desc("bytes"), F.col("top")).select(*_row("material", F.lpad(F.col("pos").cast("string"), 2, "0"), F.concat(F.lit("- **"), _code(F.concat("top", F.lit("/"))), F.lit("** — "), F.col("count").cast("string"), F.lit(" files, "), size, F.lit(" — "), kinds, tail)))

    top = _ranked(graph.ranked(impact(src)), F.desc("n_used_by"), F.desc("n_tests"), F.col("target"))
    used = F.when(F.col("n_used_by") > 0, F.concat(F.lit("used by "), _listed(F.col("used_by"), graph.MAX_USED_BY, F.col("n_used_by"))))
    tested = F.when(F.col("n_tests") > 0, F.concat(F.lit("**tested by** "), _listed(F.col("tests"), graph.MAX_TESTS, F.col("n_tests"))))
    impact_rows = top.select(*_row("impact", F.lpad(F.col("pos").cast("string"), 4, "0"), F.concat(F.lit("- **"), _code(F.col("target")), F.lit("** — "), F.concat_ws("; ", used, tested))))

    said = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(" — "), c)).otherwise("")
    methods = lambda c: F.when(F.size(c["methods"]) > 0, F.concat(F.lit("\n  - methods: "), F.array_join(F.slice(c["methods"], 1, MAX_METHODS), ", "))).otherwise("")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), _code(F.col("path"))),
        F.when(F.coalesce("doc", F.lit("")) != "", F.col("doc")),
        F.when(F.size("consts") > 0, F.concat(F.lit("**Constants:** "), F.array_join(F.slice("consts", 1, MAX_CONSTS), ", "))),
        F.when(F.size("classes") > 0, F.array_join(F.transform("classes", lambda c: F.concat(F.lit("- **class "), c["name"], F.lit("**"), said(c["doc"]), methods(c))), "\n")),
        F.when(F.size("funcs") > 0, F.array_join(F.transform("funcs", lambda f: F.concat(F.lit("- "), _code(f["sig"]), said(f["doc"]))), "\n")),
    )
    columns = F.when(F.size("columns") > 0, F.concat(F.lit("\ncolumns: "), F.array_join("columns", ", "))).otherwise("")
    table_detail = t.select(*_row("detail", F.concat(F.lit("1"), F.lower("name")), F.concat(F.lit("### "), F.col("name"), F.when(F.col("summary") != "", F.concat(F.lit("\n"), F.col("summary"))).otherwise(""), columns, F.lit("\ndefined in "), _code(F.col("source")))))
    file_detail = src.select(*_row("detail", F.concat(F.lit("2"), F.col("path")), body))

    out = index
    for part in (table_rows, route_more, route_rows, env_more, env_rows, deploy_rows, material_rows, impact_rows, table_detail, file_detail):
        out = out.unionByName(part)
    return _scrubbed(out)


TITLES = {"index": "Quick Index", "tables": "Data model", "routes": "API surface", "settings": "Configuration", "deployment": "Deployment", "material": "Stored material (not source)", "impact": "Impact", "detail": "Full Detail"}


def document_lines(files: DataFrame, title: str, found: DataFrame | None = None) -> DataFrame:
    """(section, pos, line) of the whole document, headings included, in the order in which it is read: sorted by range, never on one task."""
    spark = files.sparkSession
    lines = stored(index_lines(files, found), "index-lines")
    place = F.array_position(F.array(*map(F.lit, TITLES)), F.col("section")).cast("int")
    body = lines.select(place.alias("section"), F.concat(F.lit("1"), "pos").alias("pos"), "line")
    there = lines.select(place.alias("section")).distinct()
    headings = spark.createDataFrame([(n, "0", f"\n## {heading}\n") for n, heading in enumerate(TITLES.values(), 1)], "section int, pos string, line string").join(F.broadcast(there), "section", "left_semi")
    top = spark.createDataFrame([(0, "0", f"# Architecture map — {title}")], "section int, pos string, line string")
    return top.unionByName(headings).unionByName(body).orderBy("section", "pos")


def document(files: DataFrame, title: str, found: DataFrame | None = None) -> str:
    """The whole index as one text, for one repository: what is asked for as a file is made on the driver. document_lines() may be written by partition instead."""
    return "\n".join(r["line"] for r in document_lines(files, title, found).toLocalIterator()) + "\n"
