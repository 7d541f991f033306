"""Tasks by name, and what keeps long runs safe."""

import os

import pytest
from pyspark.sql import functions as F

from loomwork import runs, tasks


@pytest.mark.parametrize("name", tasks.list_tasks())
def test_every_task_is_valid(spark, name):
    got = tasks.validate(name, spark, 12).first().asDict()
    assert all(got.values()), got


def test_names(spark):
    assert tasks.get_task("Logic_NLI").name == "logic_nli" and tasks.get_task("codeexecution").name == "code_execution"
    with pytest.raises(KeyError):
        tasks.get_task("nothing")


def test_seeds_settings_and_scores(spark):
    a, b, c = (sorted(map(tuple, tasks.generate("arithmetics", spark, 20, seed=k).collect())) for k in (1, 1, 2))
    assert a == b != c and len(a) == 20
    with tasks.override(level=2, attempts=1):
        assert {r.level for r in tasks.generate("arithmetics", spark, 5).collect()} == {2}
    with pytest.raises(TypeError), tasks.override(nothing=1):
        pass
    assert tasks.setting("level") == 0
    df = tasks.generate("arithmetics", spark, 6, postprocess=lambda df: df.withColumn("given", F.when(F.col("id") == 0, F.col("answer")).when(F.col("id") == 1, "x")))
    got = {r.id: (r.reward.score, r.reward.tag) for r in tasks.score(df).collect()}
    assert got[0] == (1.0, "right") and got[1] == (0.0, "wrong") and got[2] == (0.0, "no answer")


def test_round_robin(spark):
    rows = sorted(tasks.mixed(spark, ["arithmetics", "code_execution"], 14, 4).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == list(range(14))
    assert [r.task for r in rows] == ["arithmetics"] * 4 + ["code_execution"] * 4 + ["arithmetics"] * 4 + ["code_execution"] * 2


def test_retries():
    calls, waits = [], []

    def fails():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("429")
        return "done"

    assert runs.retried(fails, sleep=waits.append) == "done" and waits == [70.0, 140.0, 280.0]
    with pytest.raises(ValueError):
        runs.retried(lambda: int("x"), again=lambda e: isinstance(e, OSError), sleep=waits.append)
    with pytest.raises(ZeroDivisionError):
        runs.retried(lambda: 1 / 0, attempts=2, sleep=waits.append)


def test_locks_states_and_memory(tmp_path):
    lock = tmp_path / "run.lock"
    with runs.locked(lock) as beat:
        beat()
        with pytest.raises(runs.Busy), runs.locked(lock):
            pass
    assert not lock.exists()
    lock.touch()
    os.utime(lock, (1, 1))
    with runs.locked(lock):
        assert lock.exists()
    state = tmp_path / "state.json"
    assert runs.load_state(state) is None
    runs.save_state(state, {"step": 1})
    runs.save_state(state, {"step": 2})
    assert runs.load_state(state) == {"step": 2}
    state.write_text("{")
    assert runs.load_state(state) == {"step": 1}
    assert runs.run_hash({"a": 1, "b": 2}) == runs.run_hash({"b": 2, "a": 1}) != runs.run_hash({"a": 2, "b": 2})
    assert runs.used_memory() > 0 and runs.over_memory(1) and not runs.over_memory(1 << 50)
    assert runs.worker_count(10) == 4 and runs.worker_count(1) == 1
