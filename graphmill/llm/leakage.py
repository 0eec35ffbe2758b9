"""Held-out items whose passages appear in training texts.

A distributed positional inverted index of the corpus: one narrow pass turns
each text into its words' positions, keeping only stretches of at least
``passage`` consecutive words that all occur in the held-out items, for no other
position can lie in a leaked passage. Postings of the rarest word of each
held-out window (by document frequency in the whole index) are joined with the
windows; the other words of a window are then intersected offset by offset.

Proximity matches have an index of their own, which keeps every position of
every held-out word: a window of which k words may be missing is anchored at
pairs of its k + 2 rarest words, two of which each match must hold.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import durable

#: Fewest consecutive words of an item that count as a leak.
PASSAGE = 12
#: Words of one indexed block of a stretch; a longer stretch is cut into blocks that overlap by PASSAGE - 1.
BLOCK = 256
#: Most distinct words and windows of held-out items that are sent to every task at once; more are taken block by block.
MAX_VOCABULARY, MAX_WINDOWS = 1_000_000, 500_000

_WORD = re.compile(r"[^\W_]+")
#: A word broken at a line end: hyphen, line break, then the next line's indent and comment or quote marks.
_BROKEN = re.compile(r"(?<=[^\W_])[-‐‑­][ \t]*(?:\r\n|\r|\n)[ \t]*(?:(?://+|/?\*+|#+|>+|--|;+|\|+|!+)[ \t]*)*(?=[^\W_])")
_ESCAPED = re.compile(r"\\[nrt]")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def words(text: str | None) -> list[str]:
    """The words that count: runs of letters and digits, in compatibility form and folded case.

    Null gives none. HTML escapes are resolved, invisible characters (format
    characters, variation selectors) dropped, words broken by a hyphen at a line
    end joined, and the \\n, \\r and \\t of a quoted string taken as blanks.
    """
    if not text:
        return []
    if "&" in text:
        for _ in range(2):
            if not _ENTITY.search(text):
                break
            text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPED.sub(" ", text)
    if not text.isascii():
        text = _BROKEN.sub("", text)  # before soft hyphens vanish
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if c.isascii() or not (unicodedata.category(c) == "Cf" or "︀" <= c <= "️"))
        text = unicodedata.normalize("NFC", text.casefold())
    else:
        text = text.lower()
    if "-" in text or "‐" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text)


def _windows(items: DataFrame, passage: int) -> Iterator[tuple[list[tuple[object, int, tuple[str, ...]]], dict[str, int]]]:
    """All windows of the held-out items, in blocks of bounded size, with the numbers of each block's words.

    The items stream through the driver one at a time, and it holds one block.
    """
    out: list = []
    vocabulary: dict[str, int] = {}
    for item, text in items.toLocalIterator():
        w = words(text)
        for i in range(len(w) - passage + 1):
            if len(out) >= MAX_WINDOWS or len(vocabulary) > MAX_VOCABULARY - passage:
                yield out, vocabulary
                out, vocabulary = [], {}
            window = tuple(w[i : i + passage])
            out.append((item, i, window))
            for x in window:
                vocabulary.setdefault(x, len(vocabulary))
    if out:
        yield out, vocabulary


def index_corpus(docs: DataFrame, vocabulary: dict[str, int], key: str, text: str, passage: int = PASSAGE) -> DataFrame:
    """(key, start, terms): blocks of consecutive words that all lie in `vocabulary`, start being the first one's position."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key_type = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for b in batches:
            keys, starts, blocks = [], [], []
            for k, t in zip(b[key], b[text]):
                ids = [get(w, -1) for w in words(t)]
                ids.append(-1)
                begin = None
                for i, x in enumerate(ids):
                    if x >= 0:
                        begin = i if begin is None else begin
                        continue
                    if begin is not None and i - begin >= passage:
                        step = BLOCK - passage + 1
                        for s in range(begin, i - passage + 1, step):
                            keys.append(k)
                            starts.append(s)
                            blocks.append(ids[s : min(i, s + BLOCK)])
                    begin = None
            yield pd.DataFrame({key: pd.Series(keys, dtype=b[key].dtype), "start": pd.Series(starts, dtype="int64"), "terms": pd.Series(blocks, dtype=object)})

    return docs.filter(F.col(key).isNotNull()).select(key, text).mapInPandas(run, f"{key} {key_type}, start long, terms array<int>")


def _candidates(docs: DataFrame, windows: list, vocabulary: dict[str, int], key: str, item: str, item_type: str, text: str, passage: int) -> DataFrame:
    """Blocks that hold the rarest word of a held-out window, with the window and the word's place."""
    index = durable(index_corpus(docs, vocabulary, key, text, passage))
    freq = index.select(F.explode(F.array_distinct("terms")).alias("term"), key).groupBy("term").agg(F.count("*").alias("df"))
    df = {r[0]: r[1] for r in freq.collect()}  # at most one row per word of the block
    rows = []
    for it, at, ws in windows:
        ids = [vocabulary[w] for w in ws]
        off = min(range(passage), key=lambda j: (df.get(ids[j], 0), ids[j], j))
        if df.get(ids[off], 0):
            rows.append((ids[off], off, it, at, ids))
    wanted = docs.sparkSession.createDataFrame(rows, f"term int, off int, {item} {item_type}, at int, ids array<int>")
    posted = index.select(key, "start", "terms", F.posexplode("terms").alias("pos", "term"))
    return posted.join(F.broadcast(wanted), "term")  # MAX_WINDOWS rows at most


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", passage: int = PASSAGE) -> DataFrame:
    """(key, item, passages, first_word) of every text that holds `passage` consecutive words of an item.

    passages counts the distinct windows of the item that the text holds, in any
    place; first_word is the place of the first, in words. Items shorter than a
    passage never leak; null texts, keys and items are none. Repeated texts are
    each reported under their own key. The items' windows are broadcast in blocks
    of MAX_WINDOWS, each against all corpus rows.
    """
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    blocks = _windows(items.filter(F.col(item).isNotNull()).select(item, text), passage)
    parts = [_candidates(docs, *block, key, item, kinds[1], text, passage) for block in blocks]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"{key} {kinds[0]}, {item} {kinds[1]}, passages long, first_word long")
    met = reduce(DataFrame.unionByName, parts)
    exact = met.filter((F.col("pos") >= F.col("off")) & (F.slice("terms", F.greatest(F.col("pos") - F.col("off") + 1, F.lit(1)), passage) == F.col("ids")))
    place = (F.col("start") + F.col("pos") - F.col("off")).alias("place")
    return exact.select(key, item, "at", place).groupBy(key, item).agg(F.countDistinct("at").alias("passages"), F.min("place").alias("first_word"))


def index_positions(docs: DataFrame, vocabulary: dict[str, int], key: str, text: str, span: int) -> DataFrame:
    """(key, terms): all words of the texts in order, -1 for those not in `vocabulary`, in blocks that overlap by span - 1.

    Blocks without a word of the vocabulary are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key_type = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for b in batches:
            keys, blocks = [], []
            for k, t in zip(b[key], b[text]):
                ids = [get(w, -1) for w in words(t)]
                for s in range(0, max(1, len(ids) - span + 1), BLOCK):
                    block = ids[s : s + BLOCK + span - 1]
                    if any(x >= 0 for x in block):
                        keys.append(k)
                        blocks.append(block)
            yield pd.DataFrame({key: pd.Series(keys, dtype=b[key].dtype), "terms": pd.Series(blocks, dtype=object)})

    return docs.filter(F.col(key).isNotNull()).select(key, text).mapInPandas(run, f"{key} {key_type}, terms array<int>")


class _Anchors:
    """Pairs of rare words that tell which windows may match at a place, and the check of a place.

    windows: (item, distinct word numbers). Of a window of m words at least the
    least n with n / m >= share must be met, so k = m - n may be missing: any
    match holds two of the k + 2 rarest (the rarest itself where n is 1).
    """

    #: Slots of the table that turns most pairs away, and places checked at a time.
    SLOTS, PLACES = 1 << 22, 8_192

    def __init__(self, windows: list[tuple[object, tuple[int, ...]]], df: dict[int, int], size: int, passage: int, share: float):
        self.size = size
        self.items = [w[0] for w in windows]
        self.words = np.full((len(windows), passage), -2, dtype=np.int32)
        self.count = np.array([len(w) for _, w in windows], dtype=np.int64)
        keys, owners = [], []
        for n, (_, ids) in enumerate(windows):
            self.words[n, : len(ids)] = ids
            need = next((c for c in range(1, len(ids) + 1) if c / len(ids) >= share), len(ids) + 1)
            if need > len(ids) or sum(1 for x in ids if df.get(x, 0)) < need:
                continue
            rare = sorted(ids, key=lambda x: (df.get(x, 0), x))[: len(ids) - need + 2]
            for x, y in combinations(rare, 2) if need > 1 else [(x, x) for x in ids]:
                keys.append(min(x, y) * size + max(x, y))
                owners.append(n)
        keys, owners = np.array(keys, dtype=np.int64), np.array(owners, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.owners = owners[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(owners)))
        self.table = np.zeros(self.SLOTS, dtype=bool)
        self.table[self.keys % self.SLOTS] = True

    def places(self, terms: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) wherever a pair of a window's anchors lies within `span` words, the place being the first's."""
        at, of = [], []
        held = np.flatnonzero(terms >= 0)
        for shift in range(span):
            i = held[held + shift < len(terms)]
            x, y = terms[i].astype(np.int64), terms[i + shift].astype(np.int64)
            key = np.minimum(x, y) * self.size + np.maximum(x, y)
            ok = (y >= 0) & self.table[key % self.SLOTS]
            i, key = i[ok], key[ok]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[spot] == key
            i, spot = i[ok], spot[ok]
            many = self.many[spot]
            begin = np.cumsum(many) - many
            at.append(np.repeat(i, many))
            of.append(self.owners[np.repeat(self.first[spot] - begin, many) + np.arange(many.sum())])
        pairs = np.unique(np.concatenate(at) * len(self.items) + np.concatenate(of))
        return pairs // len(self.items), pairs % len(self.items)

    def met(self, terms: np.ndarray, at: np.ndarray, of: np.ndarray, span: int) -> np.ndarray:
        """Most distinct words of the window in any `span` consecutive words around each place; terms is padded by span - 1."""
        out = np.zeros(len(at), dtype=np.int64)
        around = np.arange(1 - span, span)
        for s in range(0, len(at), self.PLACES):
            near = terms[at[s : s + self.PLACES, None] + around]
            hit = near[:, :, None] == self.words[of[s : s + self.PLACES]][:, None, :]
            upto = np.cumsum(hit, axis=1, dtype=np.int16)
            inside = upto[:, span - 1 :].copy()
            inside[:, 1:] -= upto[:, : span - 1]
            out[s : s + self.PLACES] = (inside > 0).sum(axis=2).max(axis=1)
        return out


def near_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", passage: int = PASSAGE, slack: int = 4, share: float = 0.8) -> DataFrame:
    """(key, item, share): proximity matches: texts that hold at least `share` of the distinct words of a window close together.

    Close together: within any passage + 2 * slack consecutive words of the
    text, in any order and with any other words between them, as for words
    replaced, inserted or left out. Exact leaks are among them with share 1.
    """
    kinds = f"{key} {dict(docs.dtypes)[key]}, {item} {dict(items.dtypes)[item]}"
    blocks = _windows(items.filter(F.col(item).isNotNull()).select(item, text), passage)
    parts = [p for p in (_near_block(docs, *block, key, item, kinds, text, passage, passage + 2 * slack, share) for block in blocks) if p is not None]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"{kinds}, share double")
    return reduce(DataFrame.unionByName, parts).groupBy(key, item).agg(F.max("share").alias("share"))


def _near_block(docs: DataFrame, found: list, vocabulary: dict[str, int], key: str, item: str, kinds: str, text: str, passage: int, span: int, share: float) -> DataFrame | None:
    """(key, item, share) of one block of windows, a pair possibly in several rows; None where no text can match."""
    windows = list(dict.fromkeys((it, tuple(sorted({vocabulary[w] for w in ws}))) for it, _, ws in found))
    index = durable(index_positions(docs, vocabulary, key, text, span))
    freq = index.select(F.explode(F.array_distinct("terms")).alias("term")).filter("term >= 0").groupBy("term").agg(F.count("*").alias("df"))
    df = {r[0]: r[1] for r in freq.collect()}  # at most one row per held-out word
    anchors = _Anchors(windows, df, len(vocabulary), passage, share)
    if not len(anchors.keys):
        return None
    shared = docs.sparkSession.sparkContext.broadcast(anchors)  # MAX_WINDOWS windows at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = shared.value
        for whole in batches:
            for s in range(0, len(whole), 256):
                b = whole.iloc[s : s + 256]
                pad = np.full(span - 1, -1, dtype=np.int32)
                parts = [pad]
                for t in b["terms"]:
                    parts += [np.asarray(t, dtype=np.int32), pad]
                terms = np.concatenate(parts)
                row = np.repeat(np.arange(len(b)), [len(t) + span - 1 for t in b["terms"]])
                at, of = a.places(terms, span)
                part = a.met(terms, at, of, span) / a.count[of]
                ok = part >= share
                keys = b[key].iloc[row[at[ok] - (span - 1)]].reset_index(drop=True)
                got = pd.DataFrame({key: keys, item: pd.Series([a.items[n] for n in of[ok]], dtype=object), "share": part[ok]})
                yield got.groupby([key, item], as_index=False, sort=False)["share"].max()

    return index.mapInPandas(run, f"{kinds}, share double")
