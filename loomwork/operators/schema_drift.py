"""Problem 6: records whose fields change from file to file, read as one table.

Each file has a schema graph: a root, the top of the record and the metadata
container below it, the fields below these, each with an edge to its type.
Two consecutive files of a stream are matched by similarity flooding: pairs of
nodes start with the likeness of their names, and scores flow along equal
edges until they settle.  Fields of one name correspond to each other.  Of the
other pairs of equal type and nesting those are taken whose fields have no
other candidate; where several could correspond the scores are reported, and
each field counts as gone or new.

Scale.  Records are parsed once, in Arrow batches that leave as the distinct
(file, field, type) of the batch.  What a pair of files yields depends only on
their two schemas, so flooding runs once per distinct pair of schemas, not
once per file; equal neighbours are dropped before.  A schema has as many rows
as fields.  The order of the files of a stream is cut into stretches, so a
stream that holds a third of all files is not sorted in one task.

Defined results.  Text that is no JSON object has no fields; a file of nothing
else has an empty schema.  A null field is absent.  A field with several types
in one file has the most frequent one, of equally frequent ones the first by
name.  Files of equal number are ordered by id; repeated rows change nothing.
Rows without file_id or stream are left out of the comparison but are in the
unified table.  An empty table has no changes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.scratch import materialise
from loomwork.sources.jsonl import dump, parse_object

FIELDS = "file_id long, field string, kind string, n long"
SCHEMA = "array<struct<field string, kind string>>"
CHANGES = "array<struct<old_field string, new_field string, kind string, score double>>"
INNER = "metadata."
STRETCH = 4096


def kind_of(value: object) -> str | None:
    """Type of a JSON value; null has none."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "decimal"
    return "array" if isinstance(value, list) else "object"


def container(record: dict) -> tuple[str | None, dict]:
    """The top field whose own fields begin with an underscore, object or JSON text, and these fields."""
    best, inner, most = None, {}, 0
    for name, value in record.items():
        if isinstance(value, str):
            value = parse_object(value) if value.lstrip()[:1] == "{" else None
        if isinstance(value, dict):
            n = sum(k.startswith("_") for k in value)
            if n > most:
                best, inner, most = name, value, n
    return best, inner


def flat(record: dict) -> Iterator[tuple[str, object]]:
    """Top fields by name, the container's by ``metadata.`` and name."""
    yield from record.items()
    for name, value in container(record)[1].items():
        yield INNER + name, value


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            record = parse_object(text) if text else None
            for field, value in flat(record or {}):
                kind = kind_of(value)
                if kind:
                    seen[(file_id, field.encode("utf-8", "replace").decode(), kind)] += 1
        keys = list(seen)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["file_id", "field", "kind", "n"])


def file_schemas(df: DataFrame) -> DataFrame:
    """(stream, file_no, file_id, schema, sig) of every file; the schema is sorted."""
    known = df.filter("file_id IS NOT NULL AND stream IS NOT NULL")
    counts = known.select("file_id", "record_json").mapInArrow(_fields, FIELDS).groupBy("file_id", "field", "kind").agg(F.sum("n").alias("n"))
    # the most frequent type; of equally frequent ones the first by name
    typed = counts.groupBy("file_id", "field").agg(F.min(F.struct(-F.col("n"), "kind")).alias("k")).select("file_id", "field", F.col("k.kind").alias("kind"))
    schemas = typed.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("field", "kind"))).alias("schema"))
    files = known.groupBy("file_id").agg(F.min(F.struct("stream", F.coalesce("file_no", F.lit(-1)).alias("file_no"))).alias("f")).select("file_id", "f.*")
    joined = files.join(schemas, "file_id", "left").withColumn("schema", F.coalesce("schema", F.array().cast(SCHEMA)))
    return joined.withColumn("sig", F.sha2(F.to_json("schema"), 256))


def with_previous(files: DataFrame) -> DataFrame:
    """Adds ``before``, the file before it in its stream; first files have none."""
    me = F.struct("file_no", "file_id", "schema", "sig")
    cut = files.withColumn("_at", F.floor(F.col("file_no") / STRETCH))
    inside = Window.partitionBy("stream", "_at").orderBy("file_no", "file_id")
    lasts = cut.groupBy("stream", "_at").agg(F.max(F.struct("file_no", "file_id")).alias("_last"))
    # one row per stretch of the stream
    lasts = lasts.select("stream", "_at", F.lag("_last").over(Window.partitionBy("stream").orderBy("_at")).alias("_last"))
    ends = lasts.join(cut.select("stream", F.struct("file_no", "file_id").alias("_last"), me.alias("_end")), ["stream", "_last"]).select("stream", "_at", "_end")
    return cut.withColumn("before", F.lag(me).over(inside)).join(ends, ["stream", "_at"], "left").withColumn("before", F.coalesce("before", "_end")).drop("_at", "_end")


def _grams(name: str) -> set[str]:
    padded = f"  {name.lower()} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def likeness(a: str, b: str) -> float:
    """Of two names, by shared runs of three letters."""
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def _graph(schema: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """Edges (from, label, to) of a schema; a field's edge from its place bears its type as label."""
    edges = [("/", "part", "/top")]
    if any(f.startswith(INNER) for f, _ in schema):
        edges.append(("/", "part", "/inner"))
    for field, kind in schema:
        edges.append(("/inner" if field.startswith(INNER) else "/top", kind, f"f:{field}"))
        edges.append((f"f:{field}", "type", f"t:{kind}"))
    return edges


def flood(old: list[tuple[str, str]], new: list[tuple[str, str]], rounds: int = 60, settled: float = 1e-4) -> dict[tuple[str, str], float]:
    """Scores of pairs of fields after similarity flooding.

    The propagation graph holds the pairs of nodes that equal labels lead to
    from a pair that is in it, beginning with the two roots; only they ever
    get a score.
    """
    out = [defaultdict(list), defaultdict(list)]
    for side, schema in zip(out, (old, new), strict=True):
        for a, label, b in _graph(schema):
            side[a, label].append(b)
    labels = defaultdict(list)
    for a, label in out[0]:
        labels[a].append(label)
    flows: dict = defaultdict(list)
    pairs, todo = {("/", "/")}, [("/", "/")]
    while todo:
        x = todo.pop()
        for label in labels[x[0]]:
            # parts and types are the same on both sides or can't be paired
            to = [(b, d) for b in out[0][x[0], label] for d in out[1].get((x[1], label), ()) if b == d or b[0] == "f"]
            for y in to:
                flows[y].append((x, 1 / len(to)))
                flows[x].append((y, 1 / len(to)))
                if y not in pairs:
                    pairs.add(y)
                    todo.append(y)
    first = {p: 1.0 if p[0] == p[1] else likeness(p[0].rpartition(".")[2].removeprefix("f:"), p[1].rpartition(".")[2].removeprefix("f:")) for p in pairs}
    score = dict(first)
    for _ in range(rounds):
        base = {p: first[p] + score[p] for p in pairs}
        after = {p: base[p] + sum(w * base[q] for q, w in flows[p]) for p in pairs}
        top = max(after.values(), default=1.0)
        after = {p: v / top for p, v in after.items()}
        moved = max((abs(after[p] - score[p]) for p in pairs), default=0.0)
        score = after
        if moved < settled:
            break
    return {(a[2:], b[2:]): v for (a, b), v in score.items() if a[0] == "f"}


def select(scores: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """The consistent correspondences among flooded pairs.

    A pair's relative score is its share of all that flowed to its old field,
    or to its new one.  Taken is a pair that has all of it on both sides: where
    a rival keeps a part, the field counts as gone or new.
    """
    left, right = Counter(), Counter()
    for (a, b), s in scores.items():
        left[a] += s
        right[b] += s
    return {(a, b): s for (a, b), s in scores.items() if s > 0 and s == left[a] == right[b]}


def correspond(old: list[tuple[str, str]], new: list[tuple[str, str]]) -> list[tuple[str, str, str, float]]:
    """Changes from one schema to the next: (old field, new field, kind, score)."""
    was, now = dict(old), dict(new)
    out = [(f, f, f"{was[f]} to {now[f]}", 1.0) for f in was if f in now and was[f] != now[f]]
    gone, come = [f for f in was if f not in now], [f for f in now if f not in was]
    if gone or come:
        went, came = set(gone), set(come)
        scores = {p: s for p, s in flood(old, new).items() if p[0] in went and p[1] in came}
        taken = select(scores)
        best_old, best_new = defaultdict(float), defaultdict(float)
        for (a, b), s in scores.items():
            best_old[a], best_new[b] = max(best_old[a], s), max(best_new[b], s)
        renamed, names = {a for a, _ in taken}, {b for _, b in taken}
        out += [(a, b, "renamed", s) for (a, b), s in taken.items()]
        out += [(a, "", "removed", best_old[a]) for a in gone if a not in renamed]
        out += [("", b, "added", best_new[b]) for b in come if b not in names]
    return sorted(out)


def _flooded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("old_field", pa.string()), ("new_field", pa.string()), ("kind", pa.string()), ("score", pa.float64())]))
    for batch in batches:
        pair = lambda x: [(f["field"], f["kind"]) for f in x]
        found = [[dict(zip(("old_field", "new_field", "kind", "score"), c, strict=True)) for c in correspond(pair(a), pair(b))] for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, shape)], names=["old_sig", "new_sig", "changes"])


def changes(df: DataFrame) -> DataFrame:
    """Every change: (file_id, stream, file_no, old_field, new_field, change, score)."""
    steps = materialise(with_previous(materialise(file_schemas(df), "schemas")).filter("before IS NOT NULL AND before.sig <> sig"), "schema-steps")
    both = steps.select(F.col("before.sig").alias("old_sig"), F.col("sig").alias("new_sig"), F.col("before.schema").alias("old"), F.col("schema").alias("new"))
    distinct = both.groupBy("old_sig", "new_sig").agg(F.first("old").alias("old"), F.first("new").alias("new"))
    # few bytes but much work: not to be put together into one task
    distinct = distinct.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "old_sig", "new_sig")
    flooded = distinct.mapInArrow(_flooded, f"old_sig string, new_sig string, changes {CHANGES}")
    joined = steps.withColumn("old_sig", F.col("before.sig")).withColumnRenamed("sig", "new_sig").join(flooded, ["old_sig", "new_sig"])
    return joined.select("file_id", "stream", "file_no", F.explode("changes").alias("c")).select("file_id", "stream", "file_no", "c.old_field", "c.new_field", F.col("c.kind").alias("change"), "c.score")


def canonical_names(found: DataFrame, schemas: DataFrame) -> dict[str, str]:
    """One name for the fields that were renamed into each other and never stand in one file.

    Bounded by the number of distinct field names, not by the data.
    """
    renames = found.filter("change = 'renamed'").groupBy("old_field", "new_field").count().collect()
    fields = schemas.groupBy("sig").agg(F.first("schema").alias("schema"), F.count("*").alias("n"))
    moved = F.array(*[F.lit(x) for x in sorted({x for r in renames for x in (r["old_field"], r["new_field"])})]).cast("array<string>")
    # only names that were ever renamed can meet
    both = fields.select(F.array_intersect("schema.field", moved).alias("own"))
    together = both.select(F.explode("own").alias("a"), "own").select("a", F.explode("own").alias("b")).distinct().collect()
    weight = {r["field"]: r["n"] for r in fields.select(F.explode("schema.field").alias("field"), "n").groupBy("field").agg(F.sum("n").alias("n")).collect()}
    clash = {(r["a"], r["b"]) for r in together}
    group = {f: {f} for f in weight}
    for r in sorted(renames, key=lambda r: (-r["count"], r["old_field"], r["new_field"])):
        a, b = group.setdefault(r["old_field"], {r["old_field"]}), group.setdefault(r["new_field"], {r["new_field"]})
        if a is not b and not any((x, y) in clash for x in a for y in b):
            a |= b
            for x in b:
                group[x] = a
    return {f: min(g, key=lambda x: (-weight.get(x, 0), x)) for f, g in group.items()}


_SPARK = {"integer": T.LongType(), "decimal": T.DoubleType(), "boolean": T.BooleanType()}


def value_kinds(df: DataFrame) -> DataFrame:
    """(field, kind) of every value of every record; integers of more than 53 bits are ``long``, of more than 64 ``huge``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch.column(0).to_pylist():
                record = parse_object(text) if text else None
                for field, value in flat(record or {}):
                    kind = kind_of(value)
                    if kind == "integer" and not -(2**53) <= value <= 2**53:
                        kind = "long" if -(2**63) <= value < 2**63 else "huge"
                    if kind:
                        seen.add((field.encode("utf-8", "replace").decode(), kind))
            yield pa.record_batch([pa.array([x[i] for x in seen], pa.string()) for i in (0, 1)], names=["field", "kind"])

    return df.select("record_json").mapInArrow(run, "field string, kind string").distinct()


def target_type(kinds: set[str]) -> T.DataType:
    """The narrowest type that holds all kinds; mixed ones and nested values are text.

    So are integers beyond 64 bits, and beside decimals those beyond 53 bits.
    """
    if kinds == {"integer", "decimal"}:
        return T.DoubleType()
    if kinds <= {"integer", "long"} and kinds:
        return T.LongType()
    return _SPARK[next(iter(kinds))] if len(kinds) == 1 and kinds <= set(_SPARK) else T.StringType()


def _cast(value: object, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.LongType):
        return value
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.BooleanType):
        return value
    return (value if isinstance(value, str) else dump(value)).encode("utf-8", "replace").decode()


def unify(df: DataFrame) -> DataFrame:
    """All records in one table: a column per canonical field, cast to a type that holds all its values.

    The columns of the input are kept; a field whose name clashes with one of
    them gets the prefix ``record.``.
    """
    found = materialise(changes(df), "schema-changes")
    schemas = materialise(file_schemas(df), "schemas")
    names = canonical_names(found, schemas)
    kinds: dict[str, set[str]] = defaultdict(set)
    for r in value_kinds(df).collect():
        kinds[names.get(r["field"], r["field"])].add(r["kind"])
    wanted = sorted(kinds)
    types = [target_type(kinds[f]) for f in wanted]
    kept = [c for c in df.columns if c != "record_json"]
    clash = {c.lower() for c in df.columns}
    column: dict[str, str] = {}
    for f in wanted:  # Spark's names don't know letter case
        name = f"record.{f}" if f.lower() in clash else f
        while name.lower() in {x.lower() for x in column.values()}:
            name += "_"
        column[f] = name
    out = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(column[f], t) for f, t in zip(wanted, types, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("record_json")).to_pylist()
            columns: list[list] = [[None] * len(texts) for _ in wanted]
            place = {f: i for i, f in enumerate(wanted)}
            for k, text in enumerate(texts):
                record = parse_object(text) if text else None
                for field, value in flat(record or {}):
                    i = place.get(names.get(field, field))
                    if i is not None and value is not None:
                        columns[i][k] = _cast(value, types[i])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(c, arrow[t.simpleString()]) for c, t in zip(columns, types, strict=True)]
            yield pa.record_batch(arrays, names=[*kept, *[column[f] for f in wanted]])

    return df.mapInArrow(run, out)
