"""Real paths where a table tells the links, and the safety of paths by allowed and denied folders.

A path is read component by component.  Up to its first link it can be told by its letters alone, ".." included, so each
round joins all such beginnings of all paths with the links at once, replaces the shortest that is a link by its target
and goes on with what follows; paths without a link left are done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import text

#: Links followed in one path before it counts as going in circles.
MOST = 40
_NONE = "cast(array() as array<string>)"


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def real_paths(paths: DataFrame, links: DataFrame, cwd: str = "/", most: int = MOST) -> DataFrame:
    """(path, real): each distinct path of paths with all links resolved; null where they lead in circles.

    That is told by what is left of a path coming again, and for circles that make it longer by ``most`` links.

    links: (link, to), absolute places of links that aren't reached through other links, and their targets, absolute or
    relative to the link's folder.  Paths needn't exist; relative ones begin at cwd.
    """
    known = shared.table(links.select(text.normal_path(F.col("link")).alias("at"), "to").groupBy("at").agg(F.min("to").alias("to")), "links")
    whole = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(f"{cwd}/"), "path"))
    # done: what is known to hold no link; rest: what follows it
    open_ = shared.table(paths.select("path").where("path is not null").distinct().select("path", F.expr(_NONE).alias("done"), _parts(whole).alias("rest"), F.expr(_NONE).alias("seen")), "paths")
    finished = []
    for _ in range(most + 1):
        begun = F.transform(F.col("rest"), lambda _, i: text.normal_path(F.concat(F.lit("/"), F.array_join(F.concat("done", F.slice("rest", F.lit(1), i + 1)), "/"))))
        places = open_.select("path", F.posexplode(begun).alias("i", "at"))
        first = places.join(known, "at").groupBy("path").agg(F.min(F.struct("i", "at", "to")).alias("hit"))
        told = open_.join(first, "path", "left").withColumn("left", F.concat_ws("/", F.array(F.lit("")), "done", F.array(F.lit("")), "rest"))
        told = shared.table(told.withColumn("circle", F.array_contains("seen", F.col("left"))), "told")
        finished.append(told.where("circle").select("path", F.lit(None).cast("string").alias("real")))
        finished.append(told.where("hit is null and not circle").select("path", text.normal_path(F.concat(F.lit("/"), F.array_join(F.concat("done", "rest"), "/"))).alias("real")))
        after = F.expr("slice(rest, hit.i + 2, size(rest))")
        folder = F.when(F.col("hit.to").startswith("/"), F.expr(_NONE)).otherwise(_parts(text.dirname(F.col("hit.at"))))
        open_ = told.where("hit is not null and not circle").select("path", folder.alias("done"), F.concat(_parts(F.col("hit.to")), after).alias("rest"), F.concat("seen", F.array("left")).alias("seen"))
        if open_.isEmpty():
            break
    else:
        finished.append(open_.select("path", F.lit(None).cast("string").alias("real")))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def verdicts(asked: DataFrame, links: DataFrame, cwd: str = "/") -> DataFrame:
    """asked (path, allow, deny, ...) with real and verdict: 'denied', 'outside', 'ok' or, for links in circles, 'loop'.

    Path and folders are compared by their real paths.  Denial wins; an empty allow list allows all; with both lists
    empty nothing is looked at.  A folder whose own links go in circles holds nothing.
    """
    rows = asked.withColumn("_k", F.monotonically_increasing_id())
    rows = shared.table(rows, "asked")
    every = rows.select("path").unionByName(rows.select(F.explode("allow").alias("path"))).unionByName(rows.select(F.explode("deny").alias("path")))
    real = shared.table(real_paths(every, links, cwd), "real")
    folder = lambda c: rows.select("_k", F.explode(c).alias("path")).distinct().join(real, "path").groupBy("_k").agg(F.collect_set("real").alias(f"_{c}"))
    both = rows.join(real, "path", "left").join(folder("allow"), "_k", "left").join(folder("deny"), "_k", "left")
    inside = lambda c: F.coalesce(F.exists(c, lambda r: (r == "/") | (F.col("real") == r) | F.col("real").startswith(F.concat(r, F.lit("/")))), F.lit(False))
    free = (F.size("allow") == 0) & (F.size("deny") == 0)
    told = F.when(free, "ok").when(F.col("real").isNull(), "loop").when(inside("_deny"), "denied").when((F.size("allow") > 0) & ~inside("_allow"), "outside").otherwise("ok")
    return both.withColumn("verdict", told).select(*asked.columns, "real", "verdict")
