"""Joins against a unique-key side that stay balanced when one key holds much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key with at least this share of the rows is joined by broadcast of its own right row.
HOT_SHARE = 0.02


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """All keys whose share of df's rows is at least `share`, at most 1/share of them and a few more.

    One pass with a mergeable frequent-items summary: it may name a key that is
    not hot, which is harmless, and never misses one that is.
    """
    found = df.select(key).stat.freqItems([key], share).first()
    items = found[0] if found and found[0] is not None else []
    return [x for x in items if x is not None]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: float = HOT_SHARE) -> DataFrame:
    """left JOIN right on `key` (same name on both sides), right being unique on it.

    Rows of hot keys meet their right rows by broadcast: these are at most about
    1/share rows, because right is unique. All other rows take a shuffle join.
    Null keys match nothing and are kept by a left join. Result rows and columns
    equal those of ``left.join(right, key, how)``.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    hot = hot_keys(left, key, share)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    warm = left.filter(~F.coalesce(is_hot, F.lit(False))).join(right, key, how)
    hot_right = right.filter(is_hot)
    return left.filter(is_hot).join(F.broadcast(hot_right), key, how).unionByName(warm)


def lead_by_blocks(df: DataFrame, key: str, pos: str, cols: list[str], block: int = 1 << 16) -> DataFrame:
    """df with ``next_{c}`` of each column: its value in the key's next row by `pos`, an integer, null in the last row.

    Windows cover `block` positions of a key, not the whole key: the last row of
    a block takes the first row of the key's next block that has any, found
    among one row per block.
    """
    blocked = df.withColumn("__b", F.floor(F.col(pos) / block))
    first = blocked.groupBy(key, "__b").agg(F.min(F.struct(F.col(pos).alias("__p"), *[F.col(c) for c in cols])).alias("__f"))
    nxt = first.select(key, "__b", F.lead("__f").over(W.partitionBy(key).orderBy("__b")).alias("__n"))
    w = W.partitionBy(key, "__b").orderBy(pos)
    here = blocked.withColumn("__here", F.lead(F.struct(*[F.col(c) for c in cols])).over(w))
    out = here.join(nxt, [key, "__b"], "left")
    return out.select(*df.columns, *[F.when(F.col("__here").isNotNull(), F.col(f"__here.{c}")).otherwise(F.col(f"__n.{c}")).alias(f"next_{c}") for c in cols])
