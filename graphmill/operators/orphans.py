"""References to records that do not exist, were deleted, or came only later."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.operators.skew import skew_join

#: Key separator inside a mask's join key; no key part holds it.
_SEP = "\u0001"


def target_life(rows: DataFrame, key_cols: list[str], version: str | None = None, deleted: str | None = None) -> DataFrame:
    """One row per key: k (the joined key parts), born (first version) and gone (deletion time of the latest row).

    Without `version` a record always exists. Rows with a null key part are no targets.
    """
    k = F.concat_ws(_SEP, *[F.col(c) for c in key_cols])
    rows = rows.dropna(subset=key_cols)
    if version is None:
        return rows.select(k.alias("k"), F.lit(None).cast("timestamp_ntz").alias("born"), F.lit(None).cast("timestamp_ntz").alias("gone")).distinct()
    gone = F.col(deleted) if deleted else F.lit(None).cast("timestamp_ntz")
    latest = F.max(F.struct(F.col(version).alias("v"), gone.alias("gone"))).alias("m")
    return rows.groupBy(k.alias("k")).agg(F.min(version).alias("born"), latest).select("k", "born", F.col("m.gone").alias("gone"))


def orphan_references(
    refs: DataFrame,
    key_cols: list[str],
    targets: Mapping[tuple[bool, ...], DataFrame],
    at: str,
    match: str = "partial",
) -> DataFrame:
    """refs that meet no living record, with a column reason: missing, late or deleted.

    key_cols form a composite key in which parts may be null. References are
    grouped by null mask (a tuple, True where the part is present), and each
    mask is looked up on its present columns in ``targets[mask]``, a table of
    `target_life` over these columns.

    match, after the SQL standard's MATCH clause:
      simple   a reference with any null part is satisfied;
      partial  its present parts must match, in targets of its mask; a mask
               without targets is satisfied;
      full     all parts null is satisfied, some null is an orphan (missing).
    All parts null is no reference under any of them.

    missing: no target has the key. late: the reference's `at` is before the
    target's first version. deleted: the latest version was deleted at or before
    `at`. The first that holds is the reason; with a null `at` only missing can.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {match}")
    parts = []
    masks = set(targets)
    whole = tuple(True for _ in key_cols)
    if match == "simple":
        masks &= {whole}
    for mask in sorted(masks):
        if not any(mask) or (match == "full" and mask != whole):
            continue
        here = [F.col(c).isNotNull() if m else F.col(c).isNull() for c, m in zip(key_cols, mask)]
        cond = here[0]
        for x in here[1:]:
            cond = cond & x
        k = F.concat_ws(_SEP, *[F.col(c) for c, m in zip(key_cols, mask) if m])
        mine = refs.filter(cond).withColumn("__k", k)  # names that no table has
        life = targets[mask].select(F.col("k").alias("__k"), F.struct("born", "gone").alias("__life"))
        seen = skew_join(mine, life, "__k", "left")
        reason = (
            F.when(F.col("__life").isNull(), "missing")
            .when(F.col(at) < F.col("__life.born"), "late")
            .when(F.col("__life.gone") <= F.col(at), "deleted")
        )
        parts.append(seen.withColumn("reason", reason).filter("reason is not null").drop("__k", "__life"))
    if match == "full":
        some, every = F.lit(False), F.lit(True)
        for c in key_cols:
            some, every = some | F.col(c).isNotNull(), every & F.col(c).isNotNull()
        parts.append(refs.filter(some & ~every).withColumn("reason", F.lit("missing")))
    if not parts:
        return refs.withColumn("reason", F.lit("missing")).filter("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
