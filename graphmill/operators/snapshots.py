"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmill.operators.skew import skew_join


def plain_digest(c: Column) -> Column:
    """A digest without its spelling: outer blanks, letter case and an ``algorithm:`` prefix do not count; blank is null."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"[\s\p{Z}]+", "")), r"^(?:.*:|0x)", "")
    return F.nullif(bare, F.lit(""))


def squeeze(c: Column) -> Column:
    """Text without any white space, for comparisons in which spacing does not count."""
    return F.regexp_replace(c, r"[\s\p{Z}]+", "")


def run_pairs(runs: DataFrame, content: DataFrame) -> DataFrame:
    """(run_id, cur_run, prev_run) of each completed run that follows a completed run of its repo.

    cur_run and prev_run name the runs whose rows are the content of this run
    and of the one before; null where that is empty. A run without rows whose
    root digest equals that of the run before repeats that run's content; a run
    without rows otherwise is empty. Pairs with the same content run on both
    sides changed nothing and are left out: the root told so. A null or blank
    root equals none. Runs are ordered by started_at, ties by run_id.
    """
    done = runs.filter(F.lower(F.trim("status")) == "completed").select(
        "repo", "run_id", "started_at", plain_digest(F.col("merkle_root")).alias("root")
    )
    has = content.select("run_id").distinct().withColumn("has", F.lit(True))
    done = done.join(has, "run_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    by = W.partitionBy("repo").orderBy("started_at", "run_id")
    same = F.coalesce(F.col("root") == F.lag("root").over(by), F.lit(False))
    done = done.withColumn("starts", (F.col("has") | ~same).cast("int")).withColumn("nth", F.row_number().over(by))
    done = done.withColumn("seg", F.sum("starts").over(by))
    # a segment's first run has the rows of the whole segment, or nobody has
    seg = W.partitionBy("repo", "seg").orderBy("started_at", "run_id")
    done = done.withColumn("cur_run", F.first(F.when(F.col("has"), F.col("run_id"))).over(seg))
    out = done.withColumn("prev_run", F.lag("cur_run").over(by)).filter("nth > 1")
    return out.filter(~F.col("cur_run").eqNullSafe(F.col("prev_run"))).select("run_id", "cur_run", "prev_run")


def snapshot_changes(
    rows: DataFrame,
    pairs: DataFrame,
    run: str = "run_id",
    key: str = "id",
    digest: str = "ast_hash",
    text: str = "signature",
    version: str = "loaded_at",
) -> DataFrame:
    """(run_id, key, change) with change in added, removed, changed for each pair of `run_pairs`.

    Within a run the row of a key with the greatest `version` counts (ties: the
    greatest digest, then text). Rows with a null key or run are no records.
    EXCEPT ALL both ways: the current side counts +1 and the previous side -1
    for each whole (run, key, digest, text) row, one aggregation drops what is
    equal on both sides, and what is left of the two differences is full-joined
    by key. A key is changed where the digests differ, or, when either digest is
    missing, where the texts differ in more than white space; two missing texts
    are equal. A content run that several pairs use is read for each of them.
    """
    best = F.max(F.struct(F.col(version), plain_digest(F.col(digest)).alias("d"), squeeze(F.col(text)).alias("t")))
    state = (
        rows.filter(F.col(run).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(run).alias("content_run"), F.col(key).alias("key"))
        .agg(best.alias("b"))
        .select("content_run", "key", "b.d", "b.t")
    )
    cur = pairs.filter("cur_run is not null").select(F.col("cur_run").alias("content_run"), "run_id", F.lit(1).alias("side"))
    prev = pairs.filter("prev_run is not null").select(F.col("prev_run").alias("content_run"), "run_id", F.lit(-1).alias("side"))
    uses = cur.unionByName(prev).groupBy("content_run").agg(F.collect_list(F.struct("run_id", "side")).alias("uses"))
    sided = skew_join(state, uses, "content_run", "inner").select(F.explode("uses").alias("u"), "key", "d", "t")
    rest = (
        sided.groupBy(F.col("u.run_id").alias("run_id"), "key", "d", "t")
        .agg(F.sum("u.side").alias("n"))
        .filter("n <> 0")
    )
    new = rest.filter("n > 0").select("run_id", "key", F.lit(True).alias("is_new"), F.col("d").alias("d1"), F.col("t").alias("t1"))
    old = rest.filter("n < 0").select("run_id", "key", F.lit(True).alias("is_old"), F.col("d").alias("d0"), F.col("t").alias("t0"))
    both = new.join(old, ["run_id", "key"], "full_outer")
    differ = F.when(F.col("d1").isNotNull() & F.col("d0").isNotNull(), F.col("d1") != F.col("d0")).otherwise(
        ~F.coalesce("t1", F.lit("")).eqNullSafe(F.coalesce("t0", F.lit("")))
    )
    change = (
        F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").when(differ, "changed")
    )
    return both.select("run_id", F.col("key").alias(key), change.alias("change")).filter("change is not null")
