"""Bodies of JSONL files, as lines that are records and lines that are not."""

from __future__ import annotations

import json
import json.scanner
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORDS = "file_key string, line_no int, answer string, metadata string, record string"


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


@contextmanager
def deep(text: str) -> Iterator[None]:
    """Room for as many nested Python calls as the brackets of the text can ask for."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1000 + 8 * (text.count("{") + text.count("["))))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def decoders(**hooks: Callable) -> tuple[Callable[[str], object], Callable[[str], object]]:
    """The fast decoder, and one for structures nested deeper than it can follow, to be used inside ``deep``."""
    patient = json.JSONDecoder(**hooks)
    patient.scan_once = json.scanner.py_make_scanner(patient)
    return json.JSONDecoder(**hooks).decode, patient.decode


_decode, _decode_deep = decoders(parse_constant=_refuse)


def parse_object(line: str) -> dict | None:
    """The object if the line is one complete JSON object, however deep, white space around it left aside."""
    line = line.strip()
    if line[:1] != "{" or line[-1:] != "}":
        return None
    try:
        value = _decode(line)
    except RecursionError:
        with deep(line):
            try:
                value = _decode_deep(line)
            except ValueError:
                return None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def dump(value: object) -> str:
    """The JSON text of a value, however deep."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[str, object]] = [("", value)]
    while todo:
        before, item = todo.pop()
        out.append(before)
        if isinstance(item, (dict, list)) and item:
            named = isinstance(item, dict)
            parts = [(f"{json.dumps(k, ensure_ascii=False)}: ", v) for k, v in item.items()] if named else [("", v) for v in item]
            out.append("{" if named else "[")
            todo.append(("}" if named else "]", None))
            todo += [((", " if i else "") + head, v) for i, (head, v) in reversed(list(enumerate(parts)))]
        elif before not in ("}", "]"):
            out.append(json.dumps(item, ensure_ascii=False))
    return "".join(out)


def body_lines(body: str) -> list[str]:
    """Lines end at "\\n" only; a byte-order mark at the start belongs to none."""
    return body.removeprefix("﻿").split("\n")


def _text(value: object) -> str | None:
    if value is None:
        return None
    text = value if isinstance(value, str) else dump(value)
    return text.encode("utf-8", "replace").decode()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, numbers, answers, metas, raw = [], [], [], [], []
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for number, line in enumerate(body_lines(body), 1):
                value = parse_object(line)
                if value is not None:
                    keys.append(key)
                    numbers.append(number)
                    answers.append(_text(value.get("answer")))
                    metas.append(_text(value.get("metadata")))
                    raw.append(line.strip())
        text = pa.string()
        yield pa.record_batch([pa.array(keys, text), pa.array(numbers, pa.int32()), pa.array(answers, text), pa.array(metas, text), pa.array(raw, text)], names=["file_key", "line_no", "answer", "metadata", "record"])


def new_records(landing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every record of the listed files that the manifest doesn't call done, once.

    A file listed several times is one file; of differing bodies the smallest
    in order counts.  Listings without a key are files of their own.  Null
    bodies have no lines.  Manifest rows of other states, without key or
    repeated don't matter.
    """
    done = manifest.filter((F.col("s") == "done") & F.col("file_key").isNotNull()).select("file_key").distinct()
    todo = landing.filter(F.col("file_body").isNotNull()).select("file_key", "file_body").join(done, "file_key", "left_anti")
    # partial aggregation keeps one copy per task of a file that is listed very often
    keyed = todo.filter("file_key IS NOT NULL").groupBy("file_key").agg(F.min("file_body").alias("file_body"))
    once = keyed.unionByName(todo.filter("file_key IS NULL"))
    return once.mapInArrow(_records, RECORDS)
