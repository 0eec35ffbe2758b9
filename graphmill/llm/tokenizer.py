"""Byte-level BPE encoding of a whole corpus with a public vocabulary.

Merges of one pre-token run on a doubly linked list of symbols with a priority
queue of (rank, position): the least rank merges first, leftmost on ties, and an
entry whose symbols have since changed is stale and skipped. A pre-token of n
bytes costs O(n log n), so a text without white space is no trap. Decoding
concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; every entry point takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Largest vocabulary file that is shipped to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: Fixed value: the vocabulary's pre-token pattern, published with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept with their ids per Python worker, and the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 40


class Bpe:
    """Encoder and decoder of one vocabulary given as lines of base64 bytes and rank."""

    def __init__(self, lines: bytes, pattern: str = PATTERN):
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        self.ranks = {base64.b64decode(tok): int(rank) for tok, rank in pairs}
        self.words = {rank: tok for tok, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def _merge(self, raw: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return (whole,)
        n = len(raw)
        # end[i]: end of the symbol that starts at byte i, 0 once it is swallowed; prev[i]: start of the symbol before
        end = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(raw[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # stale: one of the two symbols was merged meanwhile
            end[i] = stop
            end[mid] = 0
            if stop < n:
                prev[stop] = i
                r = ranks.get(raw[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i:
                p = prev[i]
                r = ranks.get(raw[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; [] for the empty text and for null. Special tokens' strings are ordinary text."""
        if not text:
            return []
        cache, out = self.cache, []
        for word in self.split(text):
            ids = cache.get(word)
            if ids is None:
                ids = self._merge(word.encode("utf-8", "replace"))
                if len(word) <= CACHE_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[word] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        return b"".join(self.words[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[int, Bpe] = {}


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) with ids an array of int for every row of df, in one narrow pass.

    Null and empty texts get an empty list; keys may repeat or be null. Other
    columns are not read. The vocabulary file is read by the driver, at most
    MAX_VOCABULARY_BYTES, and broadcast.
    """
    with open(vocabulary, "rb") as f:
        lines = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(lines) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    shared = df.sparkSession.sparkContext.broadcast(lines)

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _LOADED.get(hash(shared.value))
        if bpe is None:
            bpe = _LOADED[hash(shared.value)] = Bpe(shared.value)
        for part in parts:
            yield pd.Series([bpe.encode(t) for t in part], index=part.index, dtype=object)

    return df.select(F.col(key), encode(F.col(text)).alias("ids"))
