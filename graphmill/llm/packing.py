"""Fill containers of fixed capacity with items so that little space stays unused.

Each group (a bundle) is cut into shards of bounded size. A shard holds a BM25
inverted index of its items' terms. Containers are filled one by one: the
largest unused item is the seed; the index returns its unused neighbours, and
they fill the window greedily, the largest that fits first, ties by BM25 score;
what no neighbour can fill takes the largest unused item that fits. Containers
filled to less than the round's target are dissolved, and their items are packed
again together with those of the other shards, until the rest of a group fits one
shard; the targets fall by a fixed schedule, and the last round keeps all.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import durable

#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Items of one shard, the bound on what one task holds of a group.
SHARD_ITEMS = 4_096
#: Neighbours that the index returns for a seed.
NEIGHBOURS = 48
#: Containers filled to less than this share are packed again with other shards' rest, round by round; after these rounds all are kept.
KEEP_FILL = (0.97, 0.97, 0.95, 0.90, 0.80)
_TERM = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def terms(text: str | None) -> list[str]:
    """Lower-case identifier parts; [] for null."""
    return [t.lower() for t in _TERM.findall(text or "")]


class Index:
    """BM25 postings of one shard."""

    def __init__(self, texts: list[str | None]):
        n = len(texts)
        self.n = n
        counts = []
        for t in texts:
            c: dict[str, int] = {}
            for x in terms(t):
                c[x] = c.get(x, 0) + 1
            counts.append(c)
        length = np.array([sum(c.values()) for c in counts], dtype=float)
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        post: dict[str, list[tuple[int, int]]] = {}
        for i, c in enumerate(counts):
            for t, k in c.items():
                post.setdefault(t, []).append((i, k))
        self.postings = {}
        for t, p in post.items():
            if len(p) > 1:  # a term of one item leads to no neighbour
                ids = np.fromiter((i for i, _ in p), dtype=np.int64, count=len(p))
                tf = np.fromiter((k for _, k in p), dtype=float, count=len(p))
                idf = math.log(1 + (n - len(p) + 0.5) / (len(p) + 0.5))
                self.postings[t] = (ids, idf * tf * (K1 + 1) / (tf + norm[ids]))
        self.seed_terms = [list(c) for c in counts]

    def neighbours(self, seed: int, unused: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """At most k unused items that share a term with the seed, best BM25 score first, ties by position; and their scores."""
        score = np.zeros(self.n)
        for t in self.seed_terms[seed]:
            hit = self.postings.get(t)
            if hit is not None:
                score[hit[0]] += hit[1]
        score[~unused] = 0
        score[seed] = 0
        found = np.flatnonzero(score)
        if len(found) > k:
            found = found[np.argpartition(-score[found], k - 1)[:k]]
        return found, score[found]


def pack(sizes: list[int], texts: list[str | None], capacity: int) -> list[int]:
    """Container number (from 0) of each item, all sizes being in 1..capacity. Deterministic for a given order."""
    n = len(sizes)
    out = [-1] * n
    if not n:
        return out
    index = Index(texts)
    unused = np.ones(n, dtype=bool)
    size_of = np.array(sizes, dtype=np.int64)
    free = sorted((s, -i) for i, s in enumerate(sizes))  # ascending; ties: the earlier item is the later entry
    taken = 0

    def use(i: int) -> None:
        unused[i] = False
        del free[bisect_right(free, (sizes[i], -i)) - 1]
        out[i] = taken

    while free:
        seed = -free[-1][1]
        use(seed)
        room = capacity - sizes[seed]
        if room and free and free[0][0] <= room:
            near, score = index.neighbours(seed, unused, NEIGHBOURS)
            fits = size_of[near] <= room
            near, score = near[fits], score[fits]
            for i in near[np.lexsort((near, -score, -size_of[near]))].tolist():
                # a neighbour is taken when it leaves no more space than the best fit of all would, or room for another
                if sizes[i] <= room and (sizes[i] == room or room - sizes[i] >= free[0][0]):
                    use(i)
                    room -= sizes[i]
                    if not free or free[0][0] > room:
                        break
        while free and free[0][0] <= room:
            k = bisect_right(free, (room, 1)) - 1
            i = -free[k][1]
            use(i)
            room -= sizes[i]
        taken += 1
    return out


_PLACED = "grp string, item string, score double, tokens long, capacity long, txt string, container string, closed boolean"


def _pack_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pack the shards of one task, each on its own."""
    pdf = pdf.sort_values(["grp", "shard", "tokens", "item"], ascending=[True, True, False, True], kind="stable").reset_index(drop=True)
    grp, shard = pdf["grp"].tolist(), pdf["shard"].tolist()
    tokens, txt, capacity = pdf["tokens"].to_numpy(), pdf["txt"].tolist(), pdf["capacity"].tolist()
    turn, last, keep = pdf["round"].tolist(), pdf["last"].tolist(), pdf["keep"].iloc[0]
    names: list[str] = []
    closed: list[bool] = []
    start = 0
    while start < len(grp):
        end = start
        while end < len(grp) and grp[end] == grp[start] and shard[end] == shard[start]:
            end += 1
        sizes = tokens[start:end]
        some = int(np.count_nonzero(sizes > 0))  # sorted: those without tokens come last
        boxes = np.zeros(end - start, dtype=np.int64)
        boxes[:some] = pack([int(x) for x in sizes[:some]], txt[start : start + some], int(capacity[start]))
        fill = np.bincount(boxes, weights=sizes)
        done = (fill >= keep * capacity[start])[boxes] | last[start]
        names += [f"{turn[start]}-{shard[start]}-{x}" for x in boxes]
        closed += done.tolist()
        start = end
    out = pdf[["grp", "item", "score", "tokens", "capacity", "txt"]].copy()
    out["container"], out["closed"] = names, closed
    out["txt"] = out["txt"].where(~out["closed"], None)  # only the next round reads it
    return out


def fill_containers(items: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(grp, container, item, score, tokens, capacity) of every item or part of one, placed.

    items: grp, item (unique within grp), tokens, score, capacity (one per grp,
    at least 1) and txt. The capacity is never exceeded. An item larger than
    the capacity is split, and only such an item: full containers of its own
    and a remainder that is packed like an item. Null, zero and negative tokens
    take no space; such an item comes out once with 0 tokens. Null, NaN and
    negative scores are passed on. Rows with a null grp, item or capacity, or a
    capacity below 1, are left out. Container names are unique within a grp.
    """
    size = F.greatest(F.coalesce(F.col("tokens"), F.lit(0)), F.lit(0)).cast("long")
    base = items.filter("grp is not null and item is not null and capacity >= 1").select(
        F.col("grp").cast("string").alias("grp"),
        F.col("item").cast("string").alias("item"),
        F.col("score").cast("double").alias("score"),
        size.alias("tokens"),
        F.col("capacity").cast("long").alias("capacity"),
        "txt",
    )
    wholes = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("long")
    base = durable(base.withColumn("wholes", wholes))
    full = base.filter("wholes > 0").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("wholes"))))
    done = full.select("grp", "item", "score", F.col("capacity").alias("tokens"), "capacity", "txt", F.concat(F.lit("w-"), "item", F.lit("-"), "n").alias("container"), F.lit(True).alias("closed"))
    rest = base.withColumn("tokens", F.col("tokens") - F.col("wholes") * F.col("capacity")).filter("tokens > 0 or wholes = 0").drop("wholes")
    todo, out, turn = rest, [done], 0
    while True:
        # a group of any size is dealt over shards of about 0.8 * shard_items; another deal every round
        sizes = todo.groupBy("grp").agg(F.count("*").alias("n"))
        shards = F.greatest(F.lit(1), F.ceil(F.col("n") * 1.25 / shard_items)).cast("long")
        sizes = durable(sizes.withColumn("shards", F.when(F.col("n") <= shard_items, F.lit(1).cast("long")).otherwise(shards)))
        known = sizes.agg(F.sum("n"), F.max("shards")).first()
        total, many = known[0] or 0, (known[1] or 1) > 1
        if turn and not total:
            break
        # shards of large groups are tasks of their own; small groups share tasks of about the same size
        tasks = max(1, -(-total // shard_items))
        spot = F.pmod(F.xxhash64(F.lit(turn), F.col("item"), F.col("tokens")), F.col("shards"))
        task = F.when(F.col("shards") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(tasks)))).otherwise(F.concat(F.lit("g"), "grp", F.lit("-"), "shard"))
        sharded = todo.join(sizes, "grp").withColumn("shard", spot).select(
            "grp", "item", "score", "tokens", "capacity", "txt", "shard", F.lit(turn).alias("round"), F.lit(KEEP_FILL[turn] if turn < len(KEEP_FILL) else 0.0).alias("keep"), (F.col("shards") == 1).alias("last"), task.alias("task")
        )
        placed = durable(sharded.groupBy("task").applyInPandas(_pack_task, _PLACED))
        out.append(placed.filter("closed"))
        if not many or turn == len(KEEP_FILL):
            break
        todo = placed.filter("not closed").drop("container", "closed")
        turn += 1
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.select("grp", "container", "item", "score", "tokens", "capacity")
