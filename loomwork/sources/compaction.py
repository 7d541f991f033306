"""Problem 2: very many small Parquet files, copied together into few large ones.

Column chunks are copied as they are, encoded and compressed; only the footer
is decoded, its offsets moved and written anew.  Files are put together only
where their schemas are the same to the byte; a file of another schema goes to
another target file.  Rows, row groups (blocks) and schema of each target are
held against its sources before it gets its final name, and the totals of the
whole job once more at the end.

Scale.  The listing is a distributed table of paths and sizes; footers are
read in the tasks; the target file of each source comes from prefix sums of the
sizes, sliced by hash.  A task copies the sources of one target and holds one
buffer of a few MB.  A task that is run again writes another temporary file
and renames it over the same final name.  Nothing is shuffled but paths.

Defined results.  An empty folder gives an empty listing and no file.  Files
without rows contribute no block.  A source larger than the target size is
copied alone.  Page indexes and Bloom filters are left out: their inner
offsets would have to be decoded; readers do without.  Encrypted files, and
files whose chunks lie in other files, are refused with an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import prefix
from loomwork.scratch import materialise
from loomwork.sources import thrift_compact as tc

MAGIC = b"PAR1"
BUFFER = 4 << 20
TARGET_BYTES = 256 << 20
FOOTERS = "path string, size long, data_bytes long, n_rows long, n_blocks int, schema_id string"
COPIED = "target string, sources long, blocks long, n_rows long, size long"


def read_footer(fs: pafs.FileSystem, path: str, size: int) -> list:
    """The decoded FileMetaData struct."""
    with fs.open_input_file(path) as f:
        tail = f.read_at(8, size - 8)
        if size < 12 or tail[4:] != MAGIC:
            raise ValueError(f"{path} is no plain Parquet file")
        n = int.from_bytes(tail[:4], "little")
        return tc.Reader(f.read_at(n, size - 8 - n)).struct()


def schema_id(meta: list) -> str:
    """Of files that can be put together: schema, column orders and the writer's notes are the same."""
    parts = [f for f in meta if f[0] in (1, 2, 5, 7)]
    return hashlib.blake2b(tc.write_struct(parts), digest_size=16).hexdigest()


def _span(meta: list, path: str) -> tuple[int, int]:
    """First and last byte of the column chunks."""
    starts, ends = [], []
    for group in tc.get(meta, 4, [tc.STRUCT, []])[1]:
        for chunk in tc.get(group, 1)[1]:
            if tc.get(chunk, 1) or tc.get(chunk, 8) or tc.get(chunk, 3) is None:
                raise ValueError(f"{path}: encrypted chunks, or chunks in another file")
            column = tc.get(chunk, 3)
            start = min(x for x in (tc.get(column, 9), tc.get(column, 11) or None) if x is not None)
            starts.append(start)
            ends.append(start + tc.get(column, 7))
    return (min(starts), max(ends)) if starts else (4, 4)


def _moved(group: list, by: int, ordinal: int) -> list:
    """The row group's entry with its offsets moved; references to page indexes and Bloom filters are left out."""
    for chunk in tc.get(group, 1)[1]:
        chunk[:] = [f for f in chunk if f[0] not in (4, 5, 6, 7)]
        if tc.get(chunk, 2):
            tc.put(chunk, 2, tc.get(chunk, 2) + by)
        column = tc.get(chunk, 3)
        column[:] = [f for f in column if f[0] not in (14, 15)]
        for number in (9, 10, 11):
            if tc.get(column, number):
                tc.put(column, number, tc.get(column, number) + by)
    if tc.get(group, 5):
        tc.put(group, 5, tc.get(group, 5) + by)
    if tc.get(group, 7) is not None:
        tc.put(group, 7, min(ordinal, 32767))
    return group


def copy_blocks(sources: list[tuple[str, int]], target: str) -> tuple[int, int, int]:
    """Copies the files' blocks into ``target``; blocks, rows and size of what was written."""
    fs, at = pafs.FileSystem.from_uri(target)
    temporary = f"{at}.{uuid.uuid4().hex}.tmp"
    first, groups, rows, pos = None, [], 0, len(MAGIC)
    with fs.open_output_stream(temporary) as out:
        out.write(MAGIC)
        for uri, size in sources:
            from_fs, path = pafs.FileSystem.from_uri(uri)
            meta = read_footer(from_fs, path, size)
            if first is None:
                first = meta
            elif schema_id(first) != schema_id(meta):
                raise ValueError(f"{uri} has another schema than {sources[0][0]}")
            start, end = _span(meta, uri)
            with from_fs.open_input_file(path) as f:
                for k in range(start, end, BUFFER):
                    out.write(f.read_at(min(BUFFER, end - k), k))
            for group in tc.get(meta, 4, [tc.STRUCT, []])[1]:
                groups.append(_moved(group, pos - start, len(groups)))
            rows += tc.get(meta, 3)
            pos += end - start
        footer = [list(f) for f in first]
        tc.put(footer, 3, rows)
        tc.put(footer, 4, [tc.STRUCT, groups])
        data = tc.write_struct(footer)
        out.write(data + len(data).to_bytes(4, "little") + MAGIC)
    size = pos + len(data) + 8
    _validate(fs, temporary, size, schema_id(first), len(groups), rows)
    fs.move(temporary, at)
    return len(groups), rows, size


def _validate(fs: pafs.FileSystem, path: str, size: int, schema: str, blocks: int, rows: int) -> None:
    written = read_footer(fs, path, size)
    groups = tc.get(written, 4, [tc.STRUCT, []])[1]
    found = (schema_id(written), len(groups), tc.get(written, 3), sum(tc.get(g, 3) for g in groups))
    if found != (schema, blocks, rows, rows):
        raise ValueError(f"{path}: {found} written, {(schema, blocks, rows, rows)} expected")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, path = pafs.FileSystem.from_uri(uri)
            meta = read_footer(fs, path, size)
            start, end = _span(meta, uri)
            rows.append((uri, size, end - start, tc.get(meta, 3), len(tc.get(meta, 4, [0, []])[1]), schema_id(meta)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "size", "data_bytes", "n_rows", "n_blocks", "schema_id"])


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the Parquet files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"))


def plan_targets(footers: DataFrame, target_bytes: int) -> DataFrame:
    """Adds ``bin``: files of one schema whose prefix sum of sizes falls into the same stretch."""
    keyed = footers.filter("n_rows > 0").withColumn("_key", prefix.hash_key(3, F.col("path"))).withColumn("_slice", prefix.slice_of(F.col("_key"), 10))
    sums = prefix.slice_sums(keyed, ["schema_id"], "_slice", F.col("data_bytes"), "_bytes")
    offsets = prefix.slice_offsets(sums, ["schema_id"], "_slice", "_bytes", "_before")
    placed = prefix.with_prefix(keyed, offsets, ["schema_id"], "_slice", ["_key", "path"], F.col("data_bytes"), "_before", "_sum")
    total = sums.groupBy("schema_id").agg(F.sum("_bytes").alias("_total"))
    # equal stretches near the wanted size, instead of full ones and a small rest
    bins = F.greatest(F.lit(1), F.round(F.col("_total") / F.lit(float(target_bytes))))
    middle = F.col("_sum") - F.col("data_bytes") / 2
    return placed.join(total, "schema_id").withColumn("bin", F.floor(middle * bins / F.col("_total")).cast("long")).drop("_key", "_slice", "_sum", "_total")


def consolidate(spark: SparkSession, folder: str, out: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Copies the Parquet files below ``folder`` into large ones in ``out``; a row per file written."""
    footers = list_files(spark, folder).mapInArrow(_footers, FOOTERS)
    planned = plan_targets(footers, target_bytes)
    first_fs, at = pafs.FileSystem.from_uri(out)
    first_fs.create_dir(at, recursive=True)

    def copy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        name = f"part-{pdf['schema_id'].iloc[0][:8]}-{int(pdf['bin'].iloc[0]):06d}.parquet"
        blocks, rows, size = copy_blocks(list(zip(pdf["path"], (int(x) for x in pdf["size"]), strict=True)), f"{out}/{name}")
        return pd.DataFrame([(f"{out}/{name}", len(pdf), blocks, rows, size)], columns=["target", "sources", "blocks", "n_rows", "size"])

    copied = materialise(planned.groupBy("schema_id", "bin").applyInPandas(copy, COPIED), "compaction")
    want = footers.filter("n_rows > 0").agg(F.count("*"), F.sum("n_blocks"), F.sum("n_rows")).first()
    got = copied.agg(F.sum("sources"), F.sum("blocks"), F.sum("n_rows")).first()
    if tuple(x or 0 for x in want) != tuple(x or 0 for x in got):
        raise ValueError(f"files, blocks and rows: {tuple(want)} read, {tuple(got)} written")
    return copied

