"""Problem 5: tokens of every row under an existing tokenizer, and totals by slice.

The texts are partitioned, and each partition builds the prefix trie of its
own distinct pieces batch by batch: the pieces no batch before has brought are
sorted, so a walk over them is a depth-first walk of their trie, and the exact
tokenization states of a prefix are carried along to all pieces that share it
(``bpe.PrefixStates``).  The counts at the terminals are then joined to the
texts of the batch by the numbers of their chunks (``bpe.Chunks``).

Scale.  A row's tokens depend on its texts alone, so the tries are partitioned
as the texts are and nothing is shuffled or broadcast: neither texts nor
(text, piece) pairs leave the task.  A global trie would walk each distinct
piece once, but would have to move all pairs of text and piece twice; the walk
costs a hundredth of the splitting.  A frequent piece is only a frequent look
up, so there are no hot keys.  What a task keeps between batches is bounded.

Defined results.  Null and empty texts have 0 tokens.  Repeated rows are rows
of the result each; totals give the tokens of all rows and of each distinct
row once.  Null source, language, task or level is a slice of its own.  Extra
columns are ignored.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import bpe

SLICES = ["source", "lang", "task", "level"]
COUNTS = ["prompt_tokens", "completion_tokens"]


class TextTokens:
    """Token counts of texts, batch by batch, over the tries of their new pieces."""

    def __init__(self, ranks: str = bpe.RANKS) -> None:
        self.states = bpe.PrefixStates(ranks)
        self.sizes: list[int] = []
        self.chunks = bpe.Chunks(self._describe, self.sizes.clear)

    def _describe(self, new: list[list[str]]) -> None:
        distinct = sorted({piece for pieces in new for piece in pieces})
        terminal = dict(zip(distinct, self.states.counts(distinct), strict=True))
        self.sizes.extend(sum(map(terminal.__getitem__, pieces)) for pieces in new)

    def counts(self, texts: list[str | None]) -> list[int]:
        numbered = self.chunks.number(texts)
        size = self.sizes.__getitem__
        return [sum(map(size, ids)) for ids in numbered]


def _text_key(name: str):
    return F.when(F.length(name) > 0, F.unhex(F.md5(F.col(name).cast("binary"))))


def row_tokens(df: DataFrame, ranks: str = bpe.RANKS, keys: bool = False) -> DataFrame:
    """Every row's slice and tokens: row_id, source, lang, task, level, prompt_tokens, completion_tokens, tokens.

    With ``keys`` also digests of the two texts, as ``_p`` and ``_c``.
    """
    kept = ["row_id", *SLICES, *(["_p", "_c"] if keys else [])]
    rows = df.select("row_id", *SLICES, *([_text_key("prompt").alias("_p"), _text_key("completion").alias("_c")] if keys else []), "prompt", "completion")
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TextTokens(ranks)
        for batch in batches:
            n = len(kept)
            counts = [pa.array(tokens.counts(batch.column(n + i).to_pylist()), pa.int64()) for i in range(2)]
            yield pa.record_batch([*[batch.column(i) for i in range(n)], *counts], names=[*kept, *COUNTS])

    return rows.mapInArrow(run, schema).withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def tokens_by_row(df: DataFrame, ranks: str = bpe.RANKS) -> DataFrame:
    return row_tokens(df, ranks)


def token_totals(df: DataFrame, ranks: str = bpe.RANKS) -> DataFrame:
    """Per slice: rows, tokens of all rows, and rows and tokens with repeated rows once."""
    rows = row_tokens(df, ranks, keys=True)
    same = rows.groupBy("row_id", *SLICES, "_p", "_c").agg(F.count("*").alias("_n"), F.first("tokens").alias("tokens"))
    return same.groupBy(*SLICES).agg(F.sum("_n").alias("n_rows"), F.sum(F.col("tokens") * F.col("_n")).alias("tokens"), F.count("*").alias("distinct_rows"), F.sum("tokens").alias("distinct_tokens"))
