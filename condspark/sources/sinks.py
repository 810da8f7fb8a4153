"""Files written to their own places: staged beside them by tasks, then moved there by tasks.

The first job writes every text to a hidden file beside its place and tells, in a shared table, which; a task that fails
or runs twice leaves files that the table doesn't name.  Only when that job is done does a second one move the named
files to their places, which it can do again after a lost executor.  So nothing is seen of a job that fails while
writing, and a place never holds half a text.  What is left over is removed, also after a failure.  Places are
whatever pyarrow's file systems reach: local or mounted paths, or addresses of stores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import text
from ..operators import patch, paths

_TOLD = "path string, staged string, reason string"


def _at(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _there(store: stores.FileSystem, place: str) -> bool:
    return store.get_file_info(place).type != stores.FileType.NotFound


def write_files(texts: DataFrame, force: bool = False) -> DataFrame:
    """Write texts (path, text) to their paths and return (path, written, reason), reason being null where written.

    Folders are made.  A file that exists is refused, unless ``force`` has it replaced; so are paths of several rows and rows
    without text.  Texts are UTF-8 and stay as they are.  The result is a written table: the files are there when it is returned.
    """
    spark, token = texts.sparkSession, f"tmp-{uuid.uuid4().hex}"
    rows = texts.groupBy("path").agg(F.max("text").alias("text"), F.count("*").alias("n"))

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            told = []
            for path, body, n in zip(batch["path"], batch["text"], batch["n"], strict=True):
                if n > 1 or body is None:
                    told.append((path, None, "several texts" if n > 1 else "no text"))
                    continue
                store, place = _at(path)
                if not force and _there(store, place):
                    told.append((path, None, "exists"))
                    continue
                folder, _, name = place.rpartition("/")
                store.create_dir(folder, recursive=True)
                staged = f"{folder}/.{name}.{token}.{attempt}"
                with store.open_output_stream(staged) as out:
                    out.write(body.encode())
                told.append((path, staged, None))
            yield pd.DataFrame(told, columns=["path", "staged", "reason"])

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for path, staged, reason in zip(batch["path"], batch["staged"], batch["reason"], strict=True):
                if staged is not None:
                    store, place = _at(path)
                    if not _there(store, staged):  # moved by a task that was lost afterwards
                        reason = None if _there(store, place) else "lost"
                    elif not force and _there(store, place):
                        reason = "exists"
                    else:
                        store.move(staged, place)
                told.append((path, staged is not None and reason is None, reason))
            yield pd.DataFrame(told, columns=["path", "written", "reason"])

    try:
        staged = shared.table(rows.mapInPandas(stage, _TOLD), "staged")
        return shared.table(staged.mapInPandas(move, "path string, written boolean, reason string"), "written")
    finally:
        _sweep(rows.select("path"), token)


def _sweep(places: DataFrame, token: str) -> None:
    """Remove hidden files that carry the token from the folders of the places."""

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                store, place = _at(folder)
                for info in store.get_file_info(stores.FileSelector(place, allow_not_found=True)):
                    if f".{token}." in info.base_name:
                        store.delete_file(info.path)
            yield batch

    folders = places.select(text.dirname(F.col("path")).alias("folder")).where("folder <> ''").distinct()
    folders.mapInPandas(sweep, "folder string").write.format("noop").mode("overwrite").save()


def write_settings(decided: DataFrame, texts: DataFrame, force: bool = False) -> DataFrame:
    """(project, path, written, refused): what bootstrapping writes for each project.

    decided: (project, settings_path) as projects.bootstrap gives it; texts: (project, text).  A file that
    exists is left alone and told, unless ``force``.
    """
    wanted = shared.table(decided.select("project", F.col("settings_path").alias("path")).join(texts, "project"), "settings")
    done = write_files(wanted.select("path", "text"), force)
    refused = F.when(F.col("reason") == "exists", F.concat("path", F.lit(" already exists; pass force=True to overwrite"))).otherwise(F.col("reason"))
    return wanted.select("project", "path").join(done, "path").select("project", "path", "written", refused.alias("refused"))


def apply_patches(files: DataFrame, diffs: DataFrame, links: DataFrame, allow: list[str], deny: list[str], read_only: bool = False) -> DataFrame:
    """Patch files (path, code) by diffs (path, diff) where they lie, and return (path, written, said).

    said: [OK] with warnings of the syntax check, or [FATAL] and why nothing was written: read-only, a path outside
    the allowed folders or under a denied one (by real paths, see paths.verdicts), no such file, a diff that doesn't fit.
    A path of several diffs isn't written.
    """
    listed = lambda v: F.lit(v) if v else F.array().cast("array<string>")
    asked = diffs.select("path", "diff", listed(allow).alias("allow"), listed(deny).alias("deny"))
    judged = paths.verdicts(asked, links).join(files.select("path", "code"), "path", "left")
    why = (
        F.when(F.lit(read_only), "refused: read-only").when(F.col("verdict") == "denied", "path is under a denied folder").when(F.col("verdict") != "ok", "path is not under any allowed folder")
        .when(F.col("code").isNull(), F.concat(F.lit("Cannot resolve file path: "), "path"))
    )
    fine = judged.withColumn("why", why).withColumn("p", F.when(F.col("why").isNull(), patch.patched("code", "diff")))
    fine = shared.table(fine.select("path", F.coalesce("why", "p.error").alias("why"), F.col("p.patched").alias("text")), "patched")
    done = write_files(fine.where("why is null").select("path", "text"), force=True)
    told = fine.join(done, "path", "left").withColumn("warned", patch.syntax("text"))
    good = F.concat(F.lit("[OK] Patch applied to "), text.basename(F.col("path")), F.lit(" via builtin."))
    warned = F.concat(F.lit("\n[WARN] Syntax check found "), F.size("warned").cast("string"), F.lit(" issue(s):\n"), F.array_join(F.transform("warned", lambda w: F.concat(F.lit("  - "), w)), "\n"))
    said = F.when(F.col("written"), F.concat(good, F.when(F.size("warned") > 0, warned).otherwise(""))).otherwise(F.concat(F.lit("[FATAL] "), F.coalesce("why", "reason")))
    return told.select("path", F.coalesce("written", F.lit(False)).alias("written"), said.alias("said"))
