"""Block copies of Parquet files, and the records they are made of."""

import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomwork.sources import compaction, jsonl
from loomwork.sources import thrift_compact as tc


def write(folder, name, rows, **kw):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table(rows), str(folder / name), **kw)


@pytest.mark.parametrize("codec", ["none", "snappy", "zstd"])
def test_copied_blocks_hold_the_same_rows(spark, tmp_path, codec):
    src, out = tmp_path / "small", tmp_path / "large"
    for i in range(9):
        write(src, f"{i}.parquet", {"k": list(range(i * 5, i * 5 + 5)), "s": [None, "", "x" * i, "ü\n", "z"]}, compression=codec, row_group_size=2)
    copied = compaction.consolidate(spark, f"file://{src}", f"file://{out}", 1 << 30).collect()
    assert [(r.sources, r.blocks, r.n_rows) for r in copied] == [(9, 27, 45)]
    rows = {(r["k"], r["s"]) for r in spark.read.parquet(f"file://{out}").collect()}
    assert len(rows) == 45 and (8 * 5 + 2, "x" * 8) in rows
    assert pq.read_table(glob.glob(f"{out}/*.parquet")[0]).num_rows == 45


def test_other_schemas_go_to_other_files_and_empty_ones_nowhere(spark, tmp_path):
    src, out = tmp_path / "small", tmp_path / "large"
    write(src, "a.parquet", {"k": [1, 2]})
    write(src, "b.parquet", {"k": ["1"]})
    write(src, "c.parquet", {"k": pa.array([], pa.int64())})
    copied = compaction.consolidate(spark, f"file://{src}", f"file://{out}").collect()
    assert sorted((r.sources, r.n_rows) for r in copied) == [(1, 1), (1, 2)]


def test_target_size_cuts_the_listing(spark, tmp_path):
    src, out = tmp_path / "small", tmp_path / "large"
    for i in range(20):
        write(src, f"{i}.parquet", {"k": list(range(1000))}, compression="none", use_dictionary=False)
    copied = compaction.consolidate(spark, f"file://{src}", f"file://{out}", 40_000).collect()
    assert sum(r.n_rows for r in copied) == 20_000 and 3 <= len(copied) <= 6


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert compaction.consolidate(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/large").count() == 0


def test_damaged_file_is_refused(spark, tmp_path):
    src = tmp_path / "small"
    src.mkdir()
    (src / "a.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception, match="no plain Parquet file"):
        compaction.consolidate(spark, f"file://{src}", f"file://{tmp_path}/large")


def test_footers_survive_the_round_trip(tmp_path):
    write(tmp_path / "f", "a.parquet", {"k": [1, None], "d": [1.5, 2.5], "b": [True, False], "l": [[1], []]})
    data = (tmp_path / "f" / "a.parquet").read_bytes()
    n = int.from_bytes(data[-8:-4], "little")
    footer = data[-8 - n : -8]
    assert tc.write_struct(tc.Reader(footer).struct()) == footer


def landing(spark, rows):
    return spark.createDataFrame(rows, "file_key string, file_body string, extra int")


def manifest(spark, rows):
    return spark.createDataFrame(rows, "file_key string, s string")


def test_lines_that_are_records(spark):
    body = "﻿{\"answer\": 1}\r\n \n{\"a\": \"x\n{}\n[1]\n{\"a\": NaN}\n {\"answer\": null, \"metadata\": {\"k\": [1]}}\t\nnull"
    rows = [("a", body, 1), ("a", body, 2), ("done", "{}", 1), ("bad", "{}", 1), ("empty", "", 1), ("none", None, 1), (None, "{}", 1)]
    got = jsonl.new_records(landing(spark, rows), manifest(spark, [("done", "bad"), ("done", "done"), ("bad", "bad"), (None, "done")])).collect()
    assert sorted((r.file_key or "", r.line_no) for r in got) == [("", 1), ("a", 1), ("a", 4), ("a", 7), ("bad", 1)]
    texts = {r.line_no: (r.answer, r.metadata) for r in got if r.file_key == "a"}
    assert texts[1] == ("1", None) and texts[7] == (None, '{"k": [1]}')


def test_no_landing_rows(spark):
    assert jsonl.new_records(landing(spark, []), manifest(spark, [])).count() == 0


def test_very_long_and_very_deep_lines(spark):
    rows = [("a", '{"answer": "' + "x" * 2_000_000 + '"}', 1), ("b", '{"a":' * 200_000, 1)]
    got = jsonl.new_records(landing(spark, rows), manifest(spark, [])).collect()
    assert [(r.file_key, len(r.answer)) for r in got] == [("a", 2_000_000)]
