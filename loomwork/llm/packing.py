"""Problem 7: texts of varying length put into containers of fixed capacity.

Lexical retrieval packing.  Documents are sized in tokens of a public
tokenizer and reduced to their terms in one pass over the texts.  Shards of
about ``SHARD`` documents, of one domain where there is a domain column, each
get a BM25 inverted index.  The largest unused document of a shard is the seed
of a container; the index returns its unused neighbours by score, and they
fill the container greedily.  When no neighbour fits any more, the largest
unused documents that fit go in.  Only a text larger than the capacity is
split: full pieces are containers of their own, the rest is packed like a
text.  In the end, containers at most half full are merged across shards.

Scale.  Shards are hashed slices of a domain, as many as its size asks for, so
a domain that holds a third of all documents is just more shards; no task
holds more than a few thousand documents' terms.  The texts are not shuffled,
only their sizes and term counts.

Defined results.  Null and empty texts have 0 tokens and go into any
container of their shard.  Equal sizes and scores are ordered by doc_id.
Repeated doc_ids are items each.  Capacities below 1 are refused.  An empty
table gives no containers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import bpe
from loomwork.scratch import materialise

SHARD = 1000
K1, B = 1.2, 0.75
SIZED = "doc_id long, area string, tokens long, terms array<int>, counts array<int>"
PLACED = "container_kind string, capacity_tokens int, container_id string, fill long, doc_id long, piece int, first_token long, n_tokens long"


class Sizes:
    """Tokens and terms of texts, batch by batch; a chunk between spaces is worked out once."""

    def __init__(self, ranks: str) -> None:
        self.encoding, _, _ = bpe.load(ranks)
        self.chunks = bpe.Chunks(self._describe, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, tuple[int, int]] = {}
        self.tokens = np.empty(0, np.int64)
        self.terms, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)

    def _piece(self, piece: str) -> tuple[int, int]:
        """Tokens and term of a piece; those of one sign or of digits are no terms."""
        word = piece.strip().lower()
        term = zlib.crc32(word.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF if len(word) > 1 and word.isalpha() else -1
        self.pieces[piece] = known = len(self.encoding._encode_single_piece(piece.encode("utf-8", "surrogatepass"))), term
        return known

    def _describe(self, new: list[list[str]]) -> None:
        seen, describe, tokens, terms, ends = self.pieces.get, self._piece, [], [], []
        at = int(self.ends[-1])
        for pieces in new:
            total = 0
            for p in pieces:
                n, term = seen(p) or describe(p)
                total += n
                if term >= 0:
                    terms.append(term)
            tokens.append(total)
            ends.append(at + len(terms))
        self.tokens = np.concatenate([self.tokens, np.array(tokens, np.int64)])
        self.terms = np.concatenate([self.terms, np.array(terms, np.int64)])
        self.ends = np.concatenate([self.ends, np.array(ends, np.int64)])

    def sizes(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tokens, terms, their counts) of each text."""
        for ids in self.chunks.number(texts):
            own = np.array(ids, np.int64)
            begin, n = self.ends[own], self.ends[own + 1] - self.ends[own]
            where = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(own) else own
            terms, counts = np.unique(self.terms[where], return_counts=True)
            yield int(self.tokens[own].sum()), terms, counts


def size_texts(df: DataFrame, area: str | None, ranks: str = bpe.RANKS) -> DataFrame:
    """(doc_id, area, tokens, terms, counts) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(ranks)
        for batch in batches:
            rows = list(sizes.sizes(batch.column(2).to_pylist()))
            at = pa.array(np.concatenate([[0], np.cumsum([len(t) for _, t, _ in rows])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.empty(0, np.int64), *[r[i] for r in rows]]).astype(np.int32))) for i in (1, 2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int64()), *lists], names=["doc_id", "area", "tokens", "terms", "counts"])

    domain = F.col(area).cast("string") if area else F.lit(None).cast("string")
    return df.select("doc_id", domain.alias("area"), "text").mapInArrow(run, SIZED)


class Index:
    """BM25 over the documents of a shard: term postings of those still unused."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.n = len(terms)
        lengths = np.array([c.sum() for c in counts], float)
        mean = lengths.mean() if self.n and lengths.sum() else 1.0
        doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        flat = np.concatenate(terms) if self.n else np.empty(0, np.int64)
        tf = np.concatenate(counts).astype(float) if self.n else np.empty(0)
        vocab, self.term = np.unique(flat, return_inverse=True)
        df = np.bincount(self.term, minlength=len(vocab))
        idf = np.log((self.n - df + 0.5) / (df + 0.5)) if len(vocab) else np.empty(0)
        weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean)) if len(flat) else np.empty(0)
        # terms of half the shard or more weigh nothing; a term of one document finds no other
        useful = (idf[self.term] > 0) & (df[self.term] > 1) if len(flat) else np.empty(0, bool)
        self.term, self.doc, self.weight = self.term[useful], doc[useful], weight[useful]
        self.starts = np.searchsorted(self.doc, np.arange(self.n + 1))
        self.doc_terms = self.term.copy()
        self.size = len(vocab)
        self._order()

    def _order(self) -> None:
        order = np.argsort(self.term, kind="stable")
        self.term, self.doc, self.weight = self.term[order], self.doc[order], self.weight[order]
        self.at = np.searchsorted(self.term, np.arange(self.size + 1))

    def keep(self, unused: np.ndarray) -> None:
        """Leaves out the postings of used documents."""
        left = unused[self.doc]
        self.term, self.doc, self.weight = self.term[left], self.doc[left], self.weight[left]
        self.at = np.searchsorted(self.term, np.arange(self.size + 1))

    def scores(self, seed: int) -> np.ndarray:
        own = self.doc_terms[self.starts[seed] : self.starts[seed + 1]]
        begin, end = self.at[own], self.at[own + 1]
        n = end - begin
        total = int(n.sum())
        if not total:
            return np.zeros(self.n)
        # the postings of all terms, one after the other
        where = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        return np.bincount(self.doc[where], self.weight[where], self.n)


def pack_shard(ids: list, tokens: list[int], terms: list, counts: list, capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Containers of one shard, each a list of (document's place, piece, first token, tokens)."""
    containers: list[list[tuple[int, int, int, int]]] = []
    size = np.zeros(len(ids), np.int64)
    rest: dict[int, tuple[int, int]] = {}
    for k, n in enumerate(tokens):
        whole = n // capacity if n > capacity else 0
        containers += [[(k, p, p * capacity, capacity)] for p in range(whole)]
        size[k] = n - whole * capacity
        rest[k] = (whole, whole * capacity)
    unused = size > 0
    index = Index([np.asarray(t, np.int64) for t in terms], [np.asarray(c, np.int64) for c in counts])
    # by size, then by id, the largest first
    order = np.array(sorted(np.flatnonzero(unused).tolist(), key=lambda k: (-size[k], str(ids[k]))), np.int64)
    left, kept = len(order), len(order)
    entry = lambda k: (k, rest[k][0], rest[k][1], int(size[k]))
    for seed in order.tolist():
        if not unused[seed]:
            continue
        unused[seed] = False
        left -= 1
        room, own = capacity - int(size[seed]), [seed]
        if left and room:
            if left < kept / 2:
                index.keep(unused)
                kept = left
            smallest = size[order[unused[order]][-1]]
            if room >= smallest:
                score = index.scores(seed)
                near = np.flatnonzero((score > 0) & unused & (size <= room))
                for k in near[np.lexsort((near, -size[near], -score[near]))].tolist():
                    if size[k] <= room:
                        own.append(k)
                        unused[k] = False
                        room -= int(size[k])
                        if room < smallest:
                            break
                if room >= smallest:
                    free = order[unused[order]]
                    for k in free[np.searchsorted(-size[free], -room) :].tolist():
                        if size[k] <= room:
                            own.append(k)
                            unused[k] = False
                            room -= int(size[k])
                left -= len(own) - 1
        containers.append([entry(k) for k in own])
    empty = [(k, 0, 0, 0) for k, n in enumerate(tokens) if n == 0]
    if empty and not containers:
        containers.append([])
    if empty:
        containers[-1] += empty
    return containers


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each size, largest first into the first one with room."""
    room: list[int] = []
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = next((i for i, r in enumerate(room) if r >= sizes[k]), None)
        if at is None:
            at = len(room)
            room.append(capacity)
        room[at] -= sizes[k]
        out[k] = at
    return out


def pack_documents(df: DataFrame, containers: DataFrame, area: str | None = "task", ranks: str = bpe.RANKS) -> DataFrame:
    """(container_kind, capacity_tokens, container_id, fill, doc_id, piece, first_token, n_tokens) of every text or piece."""
    kinds = sorted((r.container_kind, r.capacity_tokens) for r in containers.select("container_kind", "capacity_tokens").filter("container_kind IS NOT NULL AND capacity_tokens IS NOT NULL").distinct().collect())
    if any(c < 1 for _, c in kinds):
        raise ValueError("a container holds at least one token")
    if area is not None and area not in df.columns:
        area = None
    sized = materialise(size_texts(df, area, ranks), "sized")
    # one row per domain; a key of several million values is no domain, its documents then share shards by hash
    areas = sized.groupBy("area").agg(F.count("*").alias("_docs")).withColumn("_own", F.col("_docs") >= SHARD // 4)
    tagged = sized.join(areas, sized.area.eqNullSafe(areas.area), "left").drop(areas.area)
    small = areas.filter(~F.col("_own")).agg(F.coalesce(F.sum("_docs"), F.lit(0))).first()[0]
    n = F.greatest(F.lit(1), F.round(F.when(F.col("_own"), F.col("_docs")).otherwise(small) / SHARD)).cast("long")
    name = F.when(F.col("_own"), F.coalesce("area", F.lit("-"))).otherwise(F.lit("mixed"))
    sharded = tagged.withColumn("shard", F.concat_ws("/", name, F.pmod(F.xxhash64("doc_id", "tokens"), n).cast("string")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"], na_position="first")
        ids, tokens, terms, counts = (pdf[c].tolist() for c in ("doc_id", "tokens", "terms", "counts"))
        rows = []
        for kind, capacity in kinds:
            for i, c in enumerate(pack_shard(ids, tokens, terms, counts, capacity)):
                fill = sum(x[3] for x in c)
                rows += [(kind, capacity, f"{pdf['shard'].iloc[0]}/{i}", fill, ids[k], piece, first, n_) for k, piece, first, n_ in c]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED.split(", ")]).astype({"doc_id": "Int64"})

    placed = materialise(sharded.select("shard", "doc_id", "tokens", "terms", "counts").groupBy("shard").applyInPandas(pack, PLACED), "placed")
    return _merged(placed)


def _merged(placed: DataFrame) -> DataFrame:
    """Containers at most half full, put together across shards."""
    key = ["container_kind", "capacity_tokens", "container_id"]
    open_ = placed.filter(F.col("fill") * 2 <= F.col("capacity_tokens")).select(*key, "fill").distinct()
    counts = open_.groupBy("container_kind").agg(F.count("*").alias("_n"))
    tagged = open_.join(counts, "container_kind").withColumn("_part", F.pmod(F.xxhash64("container_id"), F.greatest(F.lit(1), F.round(F.col("_n") / SHARD)).cast("long")))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "container_id"])
        to = first_fit([int(x) for x in pdf["fill"]], int(pdf["capacity_tokens"].iloc[0]))
        pdf = pdf.assign(_to=[f"merged/{pdf['_part'].iloc[0]}/{t}" for t in to])
        return pdf.assign(_fill=pdf.groupby("_to")["fill"].transform("sum"))[[*key, "_to", "_fill"]]

    moves = tagged.groupBy("container_kind", "_part").applyInPandas(merge, "container_kind string, capacity_tokens int, container_id string, _to string, _fill long")
    out = placed.join(moves, key, "left")
    return out.select("container_kind", "capacity_tokens", F.coalesce("_to", "container_id").alias("container_id"), F.coalesce("_fill", "fill").alias("fill"), "doc_id", "piece", "first_token", "n_tokens")


def packing_report(placed: DataFrame) -> DataFrame:
    """Per kind: containers, pieces, tokens, and the share of room that is used."""
    per = placed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("pieces"))
    return per.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"), F.round(F.sum("fill") / (F.count("*") * F.first("capacity_tokens")), 4).alias("used"))
