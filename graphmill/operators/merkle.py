"""Merkle snapshots of path hierarchies, and their difference by subtree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.paths import file_name, parent_dir
from graphmill.session import durable

#: Hexadecimal digits of a name's digest that choose its bucket: 4,096 buckets per folder.
BUCKET_HEX = 3


def merkle_build(leaves: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(path, kind, depth, hash) of every file and of every folder above one, '' being the top at depth 0.

    leaves: (path, hash) with unique plain paths. A folder's children are dealt
    over BUCKETS by the digest of their names; a bucket's hash is SHA-256 over
    its sorted ``name|kind|hash`` lines, the folder's over its sorted buckets'.
    No folder is ever collected whole. Built level by level upwards; the number
    of levels is the depth of the hierarchy.
    """
    files = leaves.select("path", F.lit("file").alias("kind"), F.size(F.split("path", "/")).alias("depth"), "hash")
    files = durable(files)  # the hashes are taken from the contents once
    deepest = max_depth or files.agg(F.max("depth")).first()[0]
    if not deepest:
        return files.filter("false")
    out, below = [files], None
    for d in range(deepest, 0, -1):
        here = files.filter(F.col("depth") == d)
        if below is not None:
            here = here.unionByName(below)
        line = F.concat_ws("|", file_name(F.col("path")), "kind", "hash")
        part = F.substring(F.sha2(file_name(F.col("path")), 256), 1, BUCKET_HEX).alias("part")
        bucket = here.groupBy(parent_dir(F.col("path")).alias("path"), part).agg(F.array_sort(F.collect_list(line)).alias("l"))
        bucket = bucket.select("path", F.concat_ws("|", "part", F.sha2(F.array_join("l", "\n"), 256)).alias("b"))
        folder = bucket.groupBy("path").agg(F.array_sort(F.collect_list("b")).alias("l"))
        below = folder.select("path", F.lit("dir").alias("kind"), F.lit(d - 1).alias("depth"), F.sha2(F.array_join("l", "\n"), 256).alias("hash"))
        below = durable(below)
        out.append(below)
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.withColumn("depth", F.col("depth").cast("long"))


def merkle_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of the files that differ between two trees: added, deleted or changed.

    Subtrees with equal hashes are pruned: only files whose folder differs are
    compared. A path whose kind changed is both deleted and added.
    """
    folders = old.filter("kind = 'dir'").select("path", F.col("hash").alias("a")).join(new.filter("kind = 'dir'").select("path", F.col("hash").alias("b")), "path")
    same = folders.filter("a = b").select(F.col("path").alias("parent"))

    def open_files(t: DataFrame, name: str) -> DataFrame:
        f = t.filter("kind = 'file'").withColumn("parent", parent_dir(F.col("path")))
        return f.join(same, "parent", "left_anti").select("path", F.col("hash").alias(name), F.lit(True).alias(f"has_{name}"))

    both = open_files(old, "o").join(open_files(new, "n"), "path", "full_outer")
    change = F.when(F.col("has_o").isNull(), "added").when(F.col("has_n").isNull(), "deleted").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def visited_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(visited): nodes that a pruning walk over both trees looks at, the top included."""
    a = old.select("path", "kind", F.col("hash").alias("a"))
    b = new.select("path", "kind", F.col("hash").alias("b"))
    both = a.join(b, ["path", "kind"], "full_outer")
    open_dirs = both.filter("kind = 'dir' and not (a <=> b)").select(F.col("path").alias("parent"))
    seen = both.filter("path <> ''").withColumn("parent", parent_dir(F.col("path"))).join(open_dirs, "parent", "left_semi")
    return seen.agg((F.count("*") + 1).alias("visited"))
