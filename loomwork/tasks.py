"""Tasks by name: tables of generated problems with prompts, answers and scores.

``generate("planning", spark, 1000, seed=7)`` gives rows (id, task, level,
prompt, answer, metadata); ``score`` adds the reward of answers to them.  A
generator may fail for a row (an unsolvable problem); then the next attempt's
problem takes its place, all attempts being drawn together as one table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import scorers
from loomwork.plans import grammar_tasks, graph_tasks, problems

Make = Callable[[SparkSession, dict], DataFrame]
Score = Callable[[Column, Column], Column]
SETTINGS: ContextVar[dict] = ContextVar("settings", default={})
#: Settings and what they are where nothing is said.
DEFAULTS = {"attempts": 40, "max_tokens": 8192, "level": 0}


@dataclass(frozen=True)
class Task:
    """``make`` gives (id, prompt, answer, metadata) for a table of ids; ``score`` a number for answer and reference."""

    name: str
    make: Make
    score: Score
    deprecated: bool = False


_TASKS: dict[str, Task] = {}


def task(name: str, score: Score = scorers.exact, deprecated: bool = False) -> Callable[[Make], Make]:
    """Registers a generator under a name."""

    def add(make: Make) -> Make:
        _TASKS[name] = Task(name, make, score, deprecated)
        return make

    return add


def list_tasks() -> list[str]:
    return sorted(n for n, x in _TASKS.items() if not x.deprecated)


def get_task(name: str) -> Task:
    """By name, whatever its case and underscores; an unknown or ambiguous one is an error."""
    plain = lambda x: x.replace("_", "").lower()
    found = [x for n, x in _TASKS.items() if plain(n) == plain(name)]
    if len(found) != 1:
        raise KeyError(f"{name}: {len(found)} tasks")
    return found[0]


@contextmanager
def override(**settings: object) -> Iterator[None]:
    """Other settings inside a ``with`` block; unknown ones are refused."""
    unknown = set(settings) - set(DEFAULTS)
    if unknown:
        raise TypeError(f"unknown settings: {sorted(unknown)}")
    token = SETTINGS.set({**SETTINGS.get(), **settings})
    try:
        yield
    finally:
        SETTINGS.reset(token)


def setting(name: str):
    return SETTINGS.get().get(name, DEFAULTS[name])


def token_count(text: Column) -> Column:
    """Pieces between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def generate(name: str, spark: SparkSession, n: int, seed: int = 0, postprocess: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(id, task, level, prompt, answer, metadata) of ``n`` problems; the same for the same seed."""
    one, attempts = get_task(name), setting("attempts")
    base = spark.range(n * attempts).select((F.col("id") + F.lit(seed) * 1_000_003_000).alias("c_custkey"))
    made = one.make(spark, {"customer": base})
    offset = F.lit(seed) * 1_000_003_000
    made = made.withColumn("row", F.floor((F.col("id") - offset) / attempts))
    fits = F.col("answer").isNotNull() & (token_count(F.col("prompt")) <= setting("max_tokens")) & (token_count(F.col("answer")) <= setting("max_tokens"))
    first = made.groupBy("row").agg(F.min(F.struct((~fits).alias("bad"), "id", "prompt", "answer", "metadata")).alias("x"))
    out = first.select(F.col("row").alias("id"), F.lit(one.name).alias("task"), F.lit(setting("level")).alias("level"), "x.prompt", "x.answer", "x.metadata")
    return postprocess(out)


def reward(score: Column, tag: Column) -> Column:
    """A score with a word for it."""
    return F.struct(score.cast("double").alias("score"), tag.alias("tag"))


def score(df: DataFrame, given: str = "given") -> DataFrame:
    """Adds ``reward`` to rows with a task, the answer looked for and the one given; each row is scored by its own task."""
    out = F.lit(None).cast("double")
    for name, x in sorted(_TASKS.items()):
        out = F.when(F.col("task") == name, x.score(F.col(given), F.col("answer"))).otherwise(out)
    tag = F.when(F.col(given).isNull(), "no answer").when(out >= 1, "right").when(out > 0, "partly").otherwise("wrong")
    return df.withColumn("reward", reward(F.coalesce(out, F.lit(0.0)), tag))


def mixed(spark: SparkSession, names: list[str], n: int, batch: int = 4, seed: int = 0) -> DataFrame:
    """``n`` rows in batches that go round the tasks in turn."""
    parts = None
    for k, name in enumerate(names):
        rows = generate(name, spark, -(-n // (batch * len(names))) * batch, seed)
        at = (F.floor(F.col("id") / batch) * len(names) + k) * batch + F.col("id") % batch
        part = rows.withColumn("place", at)
        parts = part if parts is None else parts.unionByName(part)
    return parts.filter(F.col("place") < n).withColumn("id", F.col("place")).drop("place")


def validate(name: str, spark: SparkSession, n: int = 10) -> DataFrame:
    """One row of checks: rows there, prompts and answers given, metadata readable, the right answer worth 1, junk less."""
    df = generate(name, spark, n)
    own = get_task(name).score
    return df.agg(
        (F.count("*") == n).alias("whole"),
        F.bool_and(F.col("prompt").isNotNull() & F.col("answer").isNotNull()).alias("filled"),
        F.bool_and(F.try_parse_json("metadata").isNotNull()).alias("readable"),
        F.bool_and(own(F.col("answer"), F.col("answer")) >= 1).alias("right_is_one"),
        F.bool_and(own(F.lit("no such answer ]["), F.col("answer")) < 1).alias("junk_is_less"),
    )


def _rows(df: DataFrame, prompt: Column, answer: Column, *meta: str) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), prompt.alias("prompt"), answer.cast("string").alias("answer"), F.to_json(F.struct(*meta)).alias("metadata"))


@task("planning")
def _planning(s: SparkSession, d: dict) -> DataFrame:
    x = problems._problems(s, d)
    found = problems.planning.plans(x).join(x, "id").filter("size(plan) > 0")
    text = F.concat_ws(" ", F.transform("plan", lambda a: a.cast("string")))
    say = F.concat_ws("\n", F.transform("actions", lambda a: F.concat(F.lit("action "), a["no"].cast("string"), F.lit(": needs "), F.bin(a["pre"]), F.lit(", forbids "), F.bin(a["neg"]), F.lit(", sets "), F.bin(a["add"]), F.lit(", clears "), F.bin(a["del"]))))
    return _rows(found, F.concat(F.lit("Facts are bits. State "), F.bin("init"), F.lit(", goal "), F.bin("want"), F.lit(" without "), F.bin("avoid"), F.lit(".\n"), say, F.lit("\nThe answer is the cheapest plan.")), text, "init", "want", "avoid", "cost")


@task("constraint_satisfaction")
def _csp(s: SparkSession, d: dict) -> DataFrame:
    x = problems._csp(s, d)
    found = problems.constraints.answers(x).join(x, "id")
    say = F.concat_ws("\n", F.transform("constraints", problems.constraints.constraint_text))
    return _rows(found, F.concat(say, F.lit("\nThe answer is "), F.when(F.col("mode") == "min", "the least solution.").otherwise("all solutions, or UNSAT.")), F.col("answer"), "bounds", "n", "mode")


@task("bayesian_inference")
def _bayes(s: SparkSession, d: dict) -> DataFrame:
    q = problems.b12_questions(s, d)
    x = problems.bayes.collect_nodes(problems.network_rows(s, d)).join(q, "id")
    found = problems.bayes.queries_answered(x).join(x, "id")
    return _rows(found, F.concat(F.to_json("nodes"), F.lit("\nThe answer is P(X"), F.col("target").cast("string"), F.lit("=1).")), F.round(F.element_at("p", 2), 4).cast("string"), "target", "given", "set")


@task("graph_pathfinding")
def _paths(s: SparkSession, d: dict) -> DataFrame:
    x = graph_tasks.g02_paths(s, d).join(graph_tasks.g11_render(s, d), "gid").withColumnRenamed("gid", "id")
    return _rows(x, F.concat("text", F.lit("\nThe answer is the first shortest path from 0 to the last node, or None.")), F.col("path"), "path")


@task("parsability")
def _parsability(s: SparkSession, d: dict) -> DataFrame:
    x = grammar_tasks.l12_corrupted(s, d).groupBy("id").agg(F.min(F.struct("bad", "sentence")).alias("x")).join(grammar_tasks._grammars(s, d), "id")
    return _rows(x, F.concat("g", F.lit("\nIs this a sentence: "), "x.bad"), F.col("x.sentence"), "g")


@task("logic_nli")
def _nli(s: SparkSession, d: dict) -> DataFrame:
    c = grammar_tasks._clauses(s, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "literals"))).alias("c"))
    say = F.concat_ws("\n", F.transform("c", lambda x: F.concat_ws(" or ", F.transform(x["literals"], lambda v: F.when(v > 0, F.concat(F.lit("p"), v.cast("string"))).otherwise(F.concat(F.lit("not p"), (-v).cast("string")))))))
    return _rows(grammar_tasks.p02_labels(s, d).join(c, "id"), F.concat(say, F.lit("\nThe last line is the hypothesis; the answer is what the others say of it.")), F.col("label"), "label")


@task("code_execution")
def _code(s: SparkSession, d: dict) -> DataFrame:
    x = grammar_tasks.programs(s, d)
    return _rows(x, F.concat("code", F.lit("\nThe answer is what it prints.")), F.when(F.length("output").between(1, 9), F.col("output")), "code")


@task("arithmetics")
def _arithmetics(s: SparkSession, d: dict) -> DataFrame:
    return _rows(grammar_tasks.l13_expressions(s, d), F.concat(F.lit("Evaluate "), "expr"), F.col("value"), "expr")
