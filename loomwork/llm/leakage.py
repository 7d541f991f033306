"""Problem 8: passages of evaluation items inside corpus documents.

Greedy string tiling.  (1) Every run of ``seed`` words is hashed by
Karp-Rabin, of items and of documents, and equal hashes are joined: that gives
the pairs of document and item with a shared seed.  (2) For each pair the
longest common runs are marked again and again, longest first, never
overlapping in either text, down to ``least`` words.  (3) A pair is reported
by its tiles: where the longest has ``longest`` words, or where all of them
together cover a share of the item, so that passages in another order count.

Scale.  The corpus is read once per ``BLOCK_SEEDS`` distinct seeds of the
items (one read for some two million words of them) and not shuffled: the
seeds of the block go to the tasks as one sorted array of bounded size, and
only documents that hold one of them leave, with their text.  Everything after
that works on these documents.  A seed that very many of them share is a hot
key of the join with the items' seeds; these are broadcast while they have at
most ``SMALL`` rows, else the join is left to the engine's skew splitting.

Defined results.  Null or empty text has no words.  Words are the longest runs
of letters and digits in lower case.  An item shorter than ``seed`` words
can't be found.  Repeated documents or items give each their own rows;
repeated rows of the same document and item ids are the same result.  Whole
texts are used, of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.scratch import materialise

WORD = re.compile(r"[^\W_]+")
BLOCK_SEEDS = 2_000_000
#: Rows of the items' seeds up to which they are broadcast, some 20 MB.
SMALL = 200_000
#: Pairs of places that are looked at together while tiles are sought.
PAIRS = 1 << 20
SCHEMA = "doc_id long, item_id long, longest int, tiles int, covered int, item_words int"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all runs of ``width`` numbers."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _BASE + x[k : k + n]
    return out


class Words:
    """64-bit numbers of words, the same in every task; keeps those it met."""

    def __init__(self, keep: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.keep = keep

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) >= self.keep:
                known.clear()
            known.update({w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(words).difference(known)})
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def seeds(self, text: str | None, width: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The distinct hashes of all runs of ``width`` words, sorted, how often each stands there, and the number of words."""
        words = words_of(text)
        hashes, n = np.unique(rolling(self.numbers(words), width), return_counts=True)
        return hashes.view(np.int64), n, len(words)


def aligned(doc: list[str], item: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers; words of the document that the item has not are negative and all different."""
    vocab: dict[str, int] = {}
    numbered = np.array([vocab.setdefault(w, len(vocab) + 1) for w in item], np.int64)
    ids = np.array([vocab.get(w, 0) for w in doc], np.int64)
    unknown = ids == 0
    ids[unknown] = -1 - np.flatnonzero(unknown)
    return ids, numbered


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[int]:
    """Lengths of the tiles: longest common runs first, none overlapping, none under ``least``."""
    doc_free, item_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[int] = []
    width = min(len(doc), len(item))
    while width >= least:
        found = _longest(doc, item, doc_free, item_free, least)
        if not found:
            break
        width = found[0][0]
        for length, at, to in found:  # all of this length, as long as they don't overlap
            if doc_free[at : at + length].all() and item_free[to : to + length].all():
                doc_free[at : at + length] = item_free[to : to + length] = False
                tiles.append(length)
    return tiles


def _longest(doc: np.ndarray, item: np.ndarray, doc_free: np.ndarray, item_free: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The longest matches of free words, at least ``least`` long, as (length, place in doc, place in item)."""

    def open_runs(ids: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(ids) - least + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[least:] == taken[:-least])
        return at, rolling(ids, least)[at]

    (da, dh), (ia, ih) = open_runs(doc, doc_free), open_runs(item, item_free)
    order = np.argsort(ih, kind="stable")
    ia, ih = ia[order], ih[order]
    lo = np.searchsorted(ih, dh, "left")
    n = np.searchsorted(ih, dh, "right") - lo
    da, lo, n = da[n > 0], lo[n > 0], n[n > 0]
    best, best_len = [], least
    ends = np.cumsum(n)
    part = 0
    while part < len(da):  # in parts of bounded size, however often runs repeat
        stop = max(part + 1, int(np.searchsorted(ends, (ends[part - 1] if part else 0) + PAIRS, "right")))
        own = n[part:stop]
        at = np.repeat(da[part:stop], own)
        to = ia[np.repeat(lo[part:stop] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(len(at))]
        part = stop
        # what is the tail of a match that began earlier is no match of its own
        tail = (at > 0) & (to > 0)
        tail &= doc_free[at - 1] & item_free[to - 1] & (doc[at - 1] == item[to - 1])
        for a, t in zip(at[~tail].tolist(), to[~tail].tolist(), strict=True):
            most = min(len(doc) - a, len(item) - t)
            same = (doc[a : a + most] == item[t : t + most]) & doc_free[a : a + most] & item_free[t : t + most]
            length = most if same.all() else int(np.argmin(same))
            if length > best_len:
                best, best_len = [(length, a, t)], length
            elif length == best_len:
                best.append((length, a, t))
    return best


def _seed_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [words.seeds(text, width) for text in batch.column(1).to_pylist()]
            n = [len(x) for x, _, _ in found]
            joined = [pa.array(np.concatenate([np.empty(0, np.int64), *[x[i] for x in found]])) for i in range(2)]
            size = pa.array(np.repeat(np.array([x[2] for x in found], np.int64), n))
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), *joined, size], names=["item", "seed", "places", "words"])

    return run


def _hit_batches(block: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            kept, hits = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own, _, _ = words.seeds(text, width)
                own = np.sort(own)
                at = np.searchsorted(block, own)
                at[at == len(block)] = 0
                hit = own[block[at] == own] if len(own) else own
                if len(hit):
                    kept.append(i)
                    hits.append(hit)
            where = pa.array(kept, pa.int64())
            ends = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hits])]).astype(np.int32))
            seeds = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *hits])))
            yield pa.record_batch([batch.column(0).take(where), batch.column(1).take(where), seeds], names=["doc_id", "text", "seeds"])

    return run


def _tile_batches(least: int, coverage: float, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, item_id, prompt in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, item = aligned(words_of(text), words_of(prompt))
                bound = _coverable(ids, item, least)
                if bound < longest and bound < coverage * len(item):
                    continue  # no tiling can reach what is asked for
                tiles = tile(ids, item, least)
                if tiles and (max(tiles) >= longest or sum(tiles) >= coverage * len(item)):
                    rows.append((doc_id, item_id, max(tiles), len(tiles), sum(tiles), len(item)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "longest", "tiles", "covered", "item_words"])

    return run


def _coverable(doc: np.ndarray, item: np.ndarray, least: int) -> int:
    """Words of the item in some run of ``least`` words that the document has: no tiling covers more."""
    runs = rolling(item, least)
    if not len(runs):
        return 0
    hit = np.isin(runs, rolling(doc, least))
    marks = np.zeros(len(item) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + least, -1)
    return int((np.cumsum(marks) > 0).sum())


def seed_blocks(seeds: DataFrame, most: int | None = None) -> Iterator[np.ndarray]:
    """The distinct seeds, sorted, in blocks of bounded size; the driver holds one at a time."""
    distinct = seeds.select("seed").distinct()
    slices = -(-distinct.count() // (most or BLOCK_SEEDS))
    for i in range(slices):
        own = distinct.filter(F.pmod(F.xxhash64("seed"), F.lit(slices)) == i) if slices > 1 else distinct
        yield np.sort(own.toPandas()["seed"].to_numpy(np.int64))


def tilings(docs: DataFrame, items: DataFrame, seed: int, least: int, longest: int, coverage: float) -> DataFrame:
    """Pairs that share a seed and whose tiles reach ``longest`` words or the ``coverage``; for this ``seed`` must not exceed ``least``."""
    key = lambda *cols: F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in cols]).cast("binary"))
    asked = items.select("item_id", "prompt").filter("item_id IS NOT NULL AND prompt IS NOT NULL").distinct().withColumn("item", key("item_id", "prompt"))
    seeds = materialise(asked.select("item", "prompt").mapInArrow(_seed_batches(seed), "item string, seed long, places long, words long"), "item-seeds")
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    hits = None
    for block in seed_blocks(seeds):
        some = materialise(texts.mapInArrow(_hit_batches(block, seed), "doc_id long, text string, seeds array<long>").withColumn("doc", key("doc_id", "text")), "seed-hits")
        hits = some if hits is None else hits.unionByName(some)
    if hits is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    shared = hits.select("doc", F.explode("seeds").alias("seed")).distinct()
    pairs = shared.join(F.broadcast(seeds) if seeds.count() <= SMALL else seeds, "seed").groupBy("doc", "item").agg(F.sum("places").alias("places"), F.max("words").alias("words"))
    # a tile of n words covers n + 1 - seed places of seeds, at least one for every ``seed`` of its words
    fewest = F.least(F.lit(float(longest + 1 - seed)), F.col("words") * F.lit(coverage) / seed)
    likely = pairs.filter(F.col("places") >= fewest).select("doc", "item").join(asked, "item").select("doc", "item_id", "prompt")
    bodies = hits.select("doc", "doc_id", "text").dropDuplicates(["doc"])
    return likely.join(bodies, "doc").select("doc_id", "text", "item_id", "prompt").mapInArrow(_tile_batches(least, coverage, longest), SCHEMA)


def leaked_passages(docs: DataFrame, items: DataFrame, words: int = 13, least: int = 5) -> DataFrame:
    """Documents with at least ``words`` consecutive words of an item, with their tiles of ``least`` words and more."""
    return tilings(docs, items, words, least, words, float("inf")).withColumn("coverage", F.col("covered") / F.col("item_words"))


def leaked_items(docs: DataFrame, items: DataFrame, words: int = 13) -> DataFrame:
    """The distinct pairs of document and item."""
    return leaked_passages(docs, items, words).select("doc_id", "item_id").distinct()


def covered_items(docs: DataFrame, items: DataFrame, coverage: float = 0.8, words: int = 5) -> DataFrame:
    """Documents whose tiles of at least ``words`` words, in any order, cover the given share of an item."""
    return tilings(docs, items, words, words, 1 << 30, coverage).withColumn("coverage", F.col("covered") / F.col("item_words"))
