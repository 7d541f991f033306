"""Problem 3: records that differ only in formatting, collapsed to one.

A record is the pair of ``answer`` and ``metadata``.  Its tree is hashed from
the leaves up: leaves are normalised to their words, numbers and operators,
the digests of an object's fields are sorted before they are hashed together,
those of a list keep their order.  Rows are grouped by the digest of the root
(128 bits), and each member's whole normalised structure is compared with that
of the first row of its group.

Scale.  Digest and structure are computed once and written to the shared
folder.  Groups are counted with partial aggregation; only digests of more
than one row meet the rows again.  Digests of very many rows (at most
``1 / HOT_SHARE`` of them can exist) are joined by broadcast, so a group that
holds a third of the table is never brought into one task; the others are
joined by shuffle.

Defined results.  Rows whose metadata is null or no readable JSON object are
copies of no other row: in ``copies`` they don't occur, in ``distinct_records``
each is one.  Null answer equals null answer only; an
answer of nothing but punctuation equals an empty one.  Numbers keep their
digits as written (1.0 is not 1.00).  A field given twice in an object counts
twice.  Structures may be nested to any depth.
Repeated row_ids are each a row; ties for the first row can't differ.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.scratch import materialise
from loomwork.sources.jsonl import decoders, deep

TOKEN = re.compile(r"(?<![\w.])\.\d+|\d+(?:\.\d+)+|[^\W_]+|[-+*/%=<>&|~^]")
#: Digests of at least this share of all grouped rows are joined by broadcast.
HOT_SHARE = 1 / 1024
SCHEMA = "row_id long, digest binary, form string"
_FIELD, _OPEN, _CLOSE, _ITEM = "\x1d", "\x02", "\x03", "\x1e"


class _Pairs(list):
    """An object's fields in the order of the text, repeated ones too."""


def normal_leaf(text: str) -> str:
    """The words, numbers and operators of a text, in lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("−", "-")
    return " ".join(TOKEN.findall(text.lower()))


class Forms:
    """Digest and normalised structure of nodes; keeps those of short leaves it met."""

    def __init__(self, keep: int = 200_000) -> None:
        self.leaves: dict[str, tuple[bytes, str]] = {}
        self.keep = keep
        self.decode, self.decode_deep = decoders(object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=_refuse)

    def leaf(self, text: str) -> tuple[bytes, str]:
        known = self.leaves.get(text)
        if known is None:
            form = normal_leaf(text)
            known = (blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest(), form)
            if len(text) < 80:
                if len(self.leaves) >= self.keep:
                    self.leaves.clear()
                self.leaves[text] = known
        return known

    def node(self, value: object) -> tuple[bytes, str]:
        kind = type(value)
        if kind is str:
            return self.leaf(value)
        if kind is _Pairs:
            leaf, node = self.leaf, self.node
            parts = []
            for key, child in value:
                (a, f), (b, g) = leaf(key), leaf(child) if type(child) is str else node(child)
                parts.append((a + b, f + _FIELD + g))
            parts.sort()
            return blake2b(b"O" + b"".join([d for d, _ in parts]), digest_size=16).digest(), "{" + _OPEN + _ITEM.join([f for _, f in parts]) + _CLOSE
        if kind is list:
            leaf, node = self.leaf, self.node
            parts = [leaf(x) if type(x) is str else node(x) for x in value]
            return blake2b(b"A" + b"".join([d for d, _ in parts]), digest_size=16).digest(), "[" + _OPEN + _ITEM.join([f for _, f in parts]) + _CLOSE
        return self.leaf("null" if value is None else "true" if value is True else "false")

    def record(self, answer: str | None, metadata: str | None) -> tuple[bytes, str] | None:
        """Of a row; None where metadata is no readable JSON object."""
        if metadata is None:
            return None
        text = metadata.lstrip("\ufeff")
        try:
            return self._record(answer, self.decode(text))
        except RecursionError:
            with deep(text):
                try:
                    return self._record(answer, self.decode_deep(text))
                except ValueError:
                    return None
        except ValueError:
            return None

    def _record(self, answer: str | None, tree: object) -> tuple[bytes, str] | None:
        if type(tree) is not _Pairs:
            return None
        (a, f), (b, g) = (b"\0", "\0") if answer is None else self.leaf(answer), self.node(tree)
        return blake2b(b"R" + a + b, digest_size=16).digest(), f + _FIELD + g


def _refuse(name: str) -> None:
    raise ValueError(name)


def _hash_batches(unreadable: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms()
        for batch in batches:
            ids, answers, metas = (batch.column(i).to_pylist() for i in range(3))
            out_ids, digests, texts = [], [], []
            for row_id, answer, meta in zip(ids, answers, metas, strict=True):
                known = forms.record(answer, meta)
                if known is not None or unreadable:
                    digest, form = known or (None, None)
                    out_ids.append(row_id)
                    digests.append(digest)
                    texts.append(form and form.encode("utf-8", "replace").decode())
            yield pa.record_batch([pa.array(out_ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(texts, pa.string())], names=["row_id", "digest", "form"])

    return run


def hashed_records(df: DataFrame, unreadable: bool = False) -> DataFrame:
    """(row_id, digest, form) of every record, written to the shared folder; of ``unreadable`` rows only the row_id."""
    return materialise(df.select("row_id", "answer", "metadata").mapInArrow(_hash_batches(unreadable), SCHEMA), "merkle")


def copy_groups(hashed: DataFrame) -> DataFrame:
    """Per distinct record: its digest, the smallest row_id and the number of rows."""
    return hashed.groupBy("digest").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("n_copies"))


def copies(df: DataFrame) -> DataFrame:
    """(first_row_id, row_id) of every row that copies a row of smaller row_id."""
    hashed = hashed_records(df)
    groups = copy_groups(hashed.select("row_id", "digest")).filter("n_copies > 1")
    repeated = materialise(groups, "merkle-groups")
    total = repeated.agg(F.sum("n_copies")).first()[0] or 0
    floor = max(2.0, total * HOT_SHARE)
    first = hashed.select(F.col("row_id").alias("first_row_id"), "digest", F.col("form").alias("first_form"))
    out = None
    for hot in (True, False):
        some = repeated.filter(F.col("n_copies") > floor if hot else F.col("n_copies") <= floor)
        # the first rows: one per group, met by its digest and id
        some = first.join(F.broadcast(some) if hot else some, ["first_row_id", "digest"]).drop("n_copies").dropDuplicates(["first_row_id", "digest"])
        part = hashed.join(F.broadcast(some) if hot else some, "digest").filter((F.col("row_id") != F.col("first_row_id")) & (F.col("form") == F.col("first_form"))).select("first_row_id", "row_id")
        out = part if out is None else out.unionByName(part)
    return out


def distinct_records(df: DataFrame) -> DataFrame:
    """One row per record: the smallest row_id, its number of copies, its digest in hex; unreadable rows have none.

    A row whose metadata can't be read as an object is a copy of no other, so
    it is a record of its own.
    """
    hashed = hashed_records(df, unreadable=True)
    # by the whole structure too: equal digests of different ones are different records
    known = hashed.filter("digest IS NOT NULL").groupBy("digest", "form").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("n_copies")).select("first_row_id", "n_copies", F.lower(F.hex("digest")).alias("digest"))
    return known.unionByName(hashed.filter("digest IS NULL").select(F.col("row_id").alias("first_row_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("string").alias("digest")))
