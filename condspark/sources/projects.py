"""Finding projects' settings and build databases in file listings, for many projects at once.

A listing is a table (path) of the files that exist, so a search is an ordered join and not a walk.
The names of the settings file and of the manifest are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

#: Folders that a search for databases leaves out, its depth, levels looked up for a manifest, words that are true.
SKIPPED = [".git", "node_modules", ".venv", "build", "dist", "__pycache__"]
DEPTH, LEVELS = 4, 10
TRUE = ["true", "yes", "1", "on"]


def _first(tried: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """(key, path): of tried (key, n, path) the path of least n that exists."""
    return tried.join(listing.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "n").alias("path"))


def truthy(value: Column) -> Column:
    """Whether a switch such as the read-only one is on; null is off."""
    return F.coalesce(F.lower(value).isin("1", "true", "yes", "on"), F.lit(False))


def existing(paths: DataFrame, listing: DataFrame, directory: str) -> DataFrame:
    """paths (path) with found: the absolute path, or the one under ``directory``, if it exists; else null."""
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(directory.rstrip("/") + "/"), "path"))
    there = listing.select(F.col("path").alias("found")).distinct().withColumn("_there", F.lit(True))
    return paths.withColumn("found", full).join(there, "found", "left").select(*paths.columns, F.when(F.col("_there"), F.col("found")).alias("found"))


def _upwards(start: Column) -> Column:
    """The folder and those above it, LEVELS in all at most."""
    parts = F.filter(F.split(start, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), F.least(n, F.lit(LEVELS - 1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n - k), "/")))


def manifests(projects: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """(project, manifest): the nearest file ``name`` in root or above it; projects: (project, root)."""
    tried = projects.select("project", F.posexplode(_upwards(F.col("root"))).alias("n", "folder")).withColumn("path", F.concat(F.regexp_replace("folder", "/$", ""), F.lit(f"/{name}")))
    return projects.select("project").join(_first(tried, listing, "project").withColumnRenamed("path", "manifest"), "project", "left")


def manifest_fields(texts: DataFrame) -> DataFrame:
    """(manifest, ord, name, key, value) of manifests (manifest, text).

    Lines "key: value" before the matrix section are fields of the whole (name null, ord 0); in it, a "### name"
    begins a project, whose number is ord, and its lines "- key: value" are its fields, the last of equal keys
    counting.  A project without fields has one row with a null key.  Lines of one '#' are comments.
    """
    rows = texts.select("manifest", F.posexplode(text.split_lines(F.col("text"))).alias("n", "line")).withColumn("line", F.regexp_replace("line", r"(?U)\s+$", ""))
    rows = rows.where((F.trim("line") != "") & ~(F.col("line").startswith("#") & ~F.col("line").startswith("##")))
    upto = W.partitionBy("manifest").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    section = F.col("line").startswith("## ")
    rows = rows.withColumn("matrix", F.coalesce(F.last(F.when(section, F.col("line").startswith("## Project Matrix")), ignorenulls=True).over(upto), F.lit(False)))
    begins = F.col("line").startswith("### ") & F.col("matrix")
    rows = rows.withColumn("ord", F.sum(begins.cast("int")).over(upto))
    # a section ends the project before it
    rows = rows.withColumn("name", F.last(F.when(begins, F.struct(F.trim(F.substring("line", 5, 1 << 30)).alias("v"))).when(section, F.struct(F.lit(None).cast("string").alias("v"))), ignorenulls=True).over(upto)["v"])
    body = F.when(F.col("line").startswith("- "), F.substring("line", 3, 1 << 30)).otherwise(F.col("line"))
    field = F.struct(F.trim(F.substring_index(body, ":", 1)).alias("key"), F.trim(F.expr("substring(b, locate(':', b) + 1)")).alias("value"))
    rows = rows.withColumn("begins", begins).withColumn("b", body).withColumn("field", F.when(F.col("line").contains(":") & ~section & ~begins, field))
    dashed = F.col("line").startswith("- ")
    own = F.col("field").isNotNull() & ((dashed & F.col("name").isNotNull()) | (~dashed & F.col("name").isNull() & ~F.col("matrix")))
    told = rows.where(F.col("begins") | own).withColumn("key", F.when(own, F.col("field.key"))).withColumn("value", F.when(own, F.col("field.value")))
    latest = told.groupBy("manifest", F.when(F.col("name").isNotNull(), F.col("ord")).otherwise(0).alias("ord"), "name", "key").agg(F.max_by("value", "n").alias("value"))
    several = F.count("*").over(W.partitionBy("manifest", "ord")) > 1
    return latest.withColumn("_m", several).where("key is not null or not _m").drop("_m")


def active_projects(fields: DataFrame) -> DataFrame:
    """(manifest, name, fields): the project that the whole names, else the first that is active; none: no row."""
    whole = fields.where("name is null and key = 'active_project'").select("manifest", F.col("value").alias("wanted"))
    own = fields.where("name is not null").groupBy("manifest", "ord", "name").agg(F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))).alias("fields"))
    both = own.join(whole, "manifest", "left")
    rank = F.when(F.col("name") == F.coalesce("wanted", F.lit("")), 0).when(F.lower(F.col("fields")["active"]).isin(TRUE), 1)
    return both.withColumn("_r", rank).where("_r is not null").groupBy("manifest").agg(F.min_by(F.struct("name", "fields"), F.struct("_r", "ord")).alias("p")).select("manifest", "p.name", "p.fields")


def find_databases(projects: DataFrame, listing: DataFrame) -> DataFrame:
    """(project, path): a build database below root; projects: (project, root).

    First those kept by project, then build/, then root itself, then the least deep, by name.
    """
    below = projects.select("project", F.concat(F.regexp_replace("root", "/$", ""), F.lit("/")).alias("root"))
    # candidates are few: only they meet the roots, by each folder above them
    named = listing.select("path").distinct().where(text.basename(F.col("path")).rlike(r"^compile_commands.*\.json$"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    pairs = named.select("path", F.explode(F.transform(above, lambda a: F.regexp_replace(a, "^//", "/"))).alias("root")).join(below, "root")
    rest = F.substring("path", F.length("root") + 1, F.lit(1 << 30))
    folders = F.slice(F.split(rest, "/"), 1, F.size(F.split(rest, "/")) - 1)
    rank = (
        F.when(rest.rlike(r"^ai/projects/[^/]+/compile_commands/[^/]+$"), 1)
        .when(rest == "build/compile_commands.json", 2)
        .when(rest == "compile_commands.json", 3)
        .when((F.size(folders) <= DEPTH) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))), 4)
    )
    found = pairs.withColumn("_r", rank).where("_r is not null").groupBy("project").agg(F.min_by("path", F.struct("_r", F.size(folders).alias("d"), "path")).alias("path"))
    return projects.select("project").join(found, "project", "left")


def find_settings(projects: DataFrame, listing: DataFrame, active: DataFrame, name: str) -> DataFrame:
    """(project, path): the settings file in use.

    projects: (project, root, cwd, home, override); active: (project, folder), the folder that the active project of
    the nearest manifest keeps its settings in.  Order: override, root, cwd, active project, home; in each
    folder ``.name`` before ``name``.
    """
    both = lambda c: [F.concat(F.regexp_replace(c, "/$", ""), F.lit(f"/{dot}{name}")) for dot in (".", "")]
    rows = projects.join(active, "project", "left")
    places = F.array(F.col("override"), *both("root"), *both("cwd"), F.concat("folder", F.lit(f"/.{name}")), *both("home"))
    tried = rows.select("project", F.posexplode(places).alias("n", "path")).where("path is not null")
    return projects.select("project").join(_first(tried, listing, "project"), "project", "left")


def chosen(given: Column, configured: Column, detected: Column) -> Column:
    """What a caller gave, else the settings, else what was detected; empty counts as not given."""
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(configured, F.lit("")), detected)


def quoted_value(value: Column) -> Column:
    """A text setting as it is written: quoted where it is empty or holds white space or a mark of the format."""
    return F.when((value == "") | value.rlike(r"""[ \t\[\]#="']"""), F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(value)


def settings_text(rows: DataFrame, head: str) -> DataFrame:
    """(project, text): settings files of rows (project, ord, section, key, value, comment), values as written."""
    entry = F.concat(F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit("# "), "comment", F.lit("\n"))).otherwise(""), "key", F.lit(" = "), "value")
    parts = rows.groupBy("project", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"]), "\n").alias("body"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda s: F.concat(F.lit("["), s["section"], F.lit("]\n"), s["body"])), "\n\n")
    return parts.groupBy("project").agg(F.concat(F.lit(f"{head}\n\n"), whole, F.lit("\n")).alias("text"))


def bootstrap(projects: DataFrame, listing: DataFrame, databases: DataFrame, targets: DataFrame, active: DataFrame, name: str, force: bool = False) -> DataFrame:
    """(project, source, path, target, settings_path, exists, write): what settings a project should get, and whether to write them.

    projects: (project, root); databases: (project, path), as a manifest declares them; targets: (path, target), by build
    database; active: (project, manifest, project_id).  Without a declared database that exists one is searched
    for; without any the target is DEFAULT.  An existing file is written over only by ``force``.
    """
    declared = databases.join(listing.select("path").distinct(), "path").select("project", F.col("path").alias("_declared"))
    found = find_databases(projects, listing).withColumnRenamed("path", "_found")
    rows = projects.join(active, "project", "left").join(declared, "project", "left").join(found, "project", "left").withColumn("path", F.coalesce("_declared", "_found"))
    rows = rows.join(targets, "path", "left").withColumn("target", F.coalesce("target", F.lit("DEFAULT")))
    base = F.coalesce(text.dirname(F.col("manifest")), F.col("root"))
    folder = F.concat(F.lit("/ai/projects/"), F.coalesce("project_id", F.lit("default")))
    rows = rows.withColumn("settings_path", F.concat(F.regexp_replace(base, "/$", ""), folder, F.lit(f"/.{name}")))
    there = listing.select(F.col("path").alias("settings_path")).distinct().withColumn("_there", F.lit(True))
    rows = rows.join(there, "settings_path", "left").withColumn("exists", F.coalesce("_there", F.lit(False)))
    source = F.when(F.col("manifest").isNull(), F.lit("none")).when(F.col("project_id").isNull(), F.lit("manifest (no active project)")).otherwise(F.lit("manifest"))
    return rows.select("project", source.alias("source"), "path", "target", "settings_path", "exists", (~F.col("exists") | F.lit(force)).alias("write"))
