"""Cut oversized texts into pieces under a token limit, at natural boundaries, with overlap.

Tokens are 13 * words / 10 rounded up, words being runs between Unicode white
space. A piece ends at the best natural boundary within reach of its start, and
the next one starts the overlap before that end. One narrow pass joins every
boundary of a text at which some piece may start to its farthest legal
successor, one row each: (id, node, next). The table is then squared by joins
with itself, all texts at once: after round k the boundaries within 2^k cuts of
a text's start are known, so the greedy cuts of all texts come out of
log2(most pieces) joins, however long a text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmill.session import durable, release

#: Fixed value: the characters with the Unicode property White_Space.
WHITE_SPACE = "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{WHITE_SPACE}]+")
_LINE_ENDS = "\u000a\u000d\u000b\u000c\u0085\u2028\u2029"
_LINE = re.compile(f"\r\n|[{_LINE_ENDS}]")
_SENTENCE = re.compile(r"[.!?;:。！？]['\")\]}»”’]*$|[{}]$")
#: Most rows of size_limits that are read to the driver.
MAX_LIMIT_ROWS = 10_000
#: Limit for every other or unknown language.
OTHER = "*"


def count_words(c: Column) -> Column:
    """Words of a text as bigint, null for null; one regular expression pass in the JVM."""
    return F.regexp_count(c, F.lit(f"[^{WHITE_SPACE}]+")).cast("long")


def count_tokens(c: Column) -> Column:
    """13 * words / 10 rounded up, as bigint; 0 for a blank text, null for null."""
    return F.floor((count_words(c) * 13 + 9) / 10).cast("long")


def words_within(tokens: int) -> int:
    """Most words that count at most `tokens` tokens."""
    return max(0, tokens * 10 // 13)


def _grades(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How natural a cut after word i is: 3 blank line, 2 line end, 1 sentence end, 0 inside."""
    n = len(starts)
    grade = np.zeros(n, dtype=np.int8)
    for i in range(n - 1):
        gap = text[ends[i] : starts[i + 1]]
        if gap != " ":
            breaks = len(_LINE.findall(gap))
            if breaks:
                grade[i] = 3 if breaks > 1 else 2
                continue
        if _SENTENCE.search(text, max(starts[i], ends[i] - 8), ends[i]):
            grade[i] = 1
    grade[n - 1] = 3
    return grade


def successors(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int, int, int]]:
    """(node, next, start, end, words) of each boundary at which a piece may start, in order; [] for a blank text.

    node and next count words; next is -1 where the piece reaches the end. start
    and end are the piece's characters. Node 0 is the first; the others are what
    some start leads to, so that every next is a node as well.

    A piece has at most max_tokens tokens, at least one word, and ends at the
    last blank line within reach if it leaves the piece at least half full,
    else the last line end, else the last sentence end, else the last word. It
    starts words_within(overlap_tokens) words before the end of the one before,
    fewer where the piece would not get ahead otherwise. Text between words
    belongs to the pieces around it; the pieces cover every word.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n == 0:
        return []
    room = max(1, words_within(max_tokens))
    back = max(0, min(words_within(overlap_tokens), room - 1))
    starts = np.fromiter((s for s, _ in spans), dtype=np.int64, count=n)
    ends = np.fromiter((e for _, e in spans), dtype=np.int64, count=n)
    grade = _grades(text, starts, ends)
    index = np.arange(n)
    far = np.minimum(index + room, n)  # exclusive end of the longest piece from each start
    stop = far.copy()
    least = np.minimum(index + max(back + 1, (room + 1) // 2), far)
    chosen = far == n
    for want in (3, 2, 1):
        last = np.maximum.accumulate(np.where(grade >= want, index, -1))[far - 1] + 1
        fits = ~chosen & (last >= least)
        stop[fits] = last[fits]
        chosen |= fits
    after = np.where(stop >= n, -1, np.maximum(stop - back, index + 1))
    nodes = np.unique(np.append(after[after > 0], 0))
    return [(int(i), int(after[i]), int(starts[i]), int(ends[stop[i] - 1]), int(stop[i] - i)) for i in nodes]


def limits_of(size_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """language -> (max_tokens, overlap_tokens), the language trimmed and in lower case; the table is small and checked."""
    rows = size_limits.select("language", "max_tokens", "overlap_tokens").limit(MAX_LIMIT_ROWS + 1).collect()
    if len(rows) > MAX_LIMIT_ROWS:
        raise ValueError(f"more than {MAX_LIMIT_ROWS} size limits")
    return {r[0].strip().lower(): (r[1], r[2] or 0) for r in rows if r[0] is not None and r[1] is not None}


def oversized(chunks: DataFrame, owners: DataFrame, limits: dict[str, tuple[int, int]], keep: list[str]) -> DataFrame:
    """Chunks with more tokens than the limit of their owner's language, one row per distinct (id, text).

    chunks: id, parent_symbol_id, text and `keep`; owners: parent_symbol_id
    (unique) and language. A null, blank or unknown language, and a missing
    owner, take the limit of '*'; without a row for '*' there is no limit then.
    Null texts have no tokens. Only chunks above the smallest limit meet the
    owners at all, the others cannot be above their own.
    """
    least = min((m for m, _ in limits.values()), default=None)
    cols = list(dict.fromkeys(["id", "parent_symbol_id", "text", *keep]))
    sized = chunks.select(*cols, count_tokens(F.col("text")).alias("tokens"))
    if least is None:
        return sized.select("*", F.lit(0).cast("long").alias("max_tokens"), F.lit(0).cast("long").alias("overlap_tokens")).filter("false")
    table = F.create_map(*[x for k, (m, o) in limits.items() for x in (F.lit(k), F.struct(F.lit(int(m)).cast("long").alias("m"), F.lit(int(o)).cast("long").alias("o")))])
    big = sized.filter(F.col("tokens") > least).dropDuplicates(["id", "text"])
    lang = F.lower(F.regexp_replace("language", f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", ""))
    lim = F.coalesce(F.try_element_at(table, F.coalesce(lang, F.lit(OTHER))), F.try_element_at(table, F.lit(OTHER)))
    out = big.join(owners.select("parent_symbol_id", "language"), "parent_symbol_id", "left").withColumn("lim", lim)
    out = out.filter(F.col("tokens") > F.col("lim.m"))
    return out.select(*cols, "tokens", F.col("lim.m").alias("max_tokens"), F.col("lim.o").alias("overlap_tokens"))


_SUCCESSOR = "id string, parent_symbol_id string, serial long, node long, next long, start long, end long, words long"


def successor_table(big: DataFrame) -> DataFrame:
    """The successors of all boundaries of all texts of `oversized`; serial tells texts of one id apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cid, parent, serial, text, most, over in zip(b.id, b.parent_symbol_id, b.serial, b.text, b.max_tokens, b.overlap_tokens):
                rows += [(cid, parent, serial, *x) for x in successors(text, int(most), int(over))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _SUCCESSOR.split(", ")])

    return big.select("id", "parent_symbol_id", "serial", "text", "max_tokens", "overlap_tokens").mapInPandas(run, _SUCCESSOR)


def reached(table: DataFrame) -> DataFrame:
    """(id, serial, node) of the boundaries that the first one of each text leads to: the greedy cuts.

    Pointer doubling by joins: `jump` leads 2^k cuts ahead in round k; what is
    reached so far, carried over by it, doubles what is reached. Each round is
    written, so a lost executor costs one round. Rows that lead to the end leave
    the table, which shrinks as it is squared.
    """
    key = ["id", "serial"]
    jump = durable(table.filter("next >= 0").select(*key, "node", "next"))
    hit = durable(table.filter("node = 0").select(*key, "node"))
    parts = [hit]
    while True:
        have = parts[0]
        for p in parts[1:]:
            have = have.unionByName(p)
        new = durable(have.join(jump, [*key, "node"]).select(*key, F.col("next").alias("node")))
        if new.limit(1).count() == 0:
            return have
        parts.append(new)  # 2^(k-1) to 2^k cuts from the start: none that is known yet
        far = jump.select(*key, F.col("node").alias("next"), F.col("next").alias("far"))
        squared = durable(jump.join(far, [*key, "next"]).select(*key, "node", F.col("far").alias("next")))
        release(jump)
        jump = squared


def pieces(big: DataFrame) -> DataFrame:
    """The numbered pieces (from 0) of each row of `oversized`: id, parent_symbol_id, piece_index, text, token_count, start_char (its place in the text).

    Blank texts have no pieces; rows with a null id are left out.
    """
    key = ["id", "serial"]
    big = durable(big.withColumn("serial", F.xxhash64("text")))
    table = durable(successor_table(big))
    cuts = table.join(reached(table), [*key, "node"])
    # a text's pieces are numbered among its few cuts, without the text
    nth = F.row_number().over(W.partitionBy(*key).orderBy("node")) - 1
    cuts = cuts.select(*key, "start", "end", "words", nth.cast("long").alias("piece_index"))
    body = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return cuts.join(big.select(*key, "parent_symbol_id", "text"), key).select(
        "id", "parent_symbol_id", "piece_index", body.alias("text"), F.floor((F.col("words") * 13 + 9) / 10).cast("long").alias("token_count"), F.col("start").alias("start_char")
    )
