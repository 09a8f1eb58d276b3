"""The numbered log: writers at the same time, checkpoints, conflicts, and what is built on it."""

import threading

import pytest

from docquarry.operators import sessions, tables
from docquarry.sources import log


def counts(spark, path):
    return log.Log(spark, str(path), lambda state, entry: state | {k: state.get(k, 0) + v for k, v in entry.items()})


def test_entries_and_checkpoints(spark, tmp_path):
    own = counts(spark, tmp_path / "log")
    assert own.state() == (0, {})
    for k in range(2 * log.EVERY + 5):
        own.commit(lambda _, k=k: {"n": 1, f"k{k % 3}": k})
    number, state = counts(spark, tmp_path / "log").state()
    assert number == state["n"] == 2 * log.EVERY + 5
    files = [f.name for f in (tmp_path / "log").iterdir() if not f.name.startswith(".")]
    assert sum(f.endswith(".state") for f in files) == 2
    assert sum(f.endswith(".entry") for f in files) < 2 * log.EVERY + 5  # old entries go
    assert own.commit(lambda state: None) == state  # nothing to change
    with pytest.raises(ZeroDivisionError):
        own.commit(lambda state: 1 // 0)
    assert own.state()[0] == number


def test_writers_at_the_same_time(spark, tmp_path):
    def work(name):
        own = counts(spark, tmp_path / "log")
        for _ in range(12):
            own.commit(lambda state: {"n": 1, name: 1})

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counts(spark, tmp_path / "log").state() == (48, {"n": 48, **{f"w{k}": 12 for k in range(4)}})


def test_a_number_is_taken_once(spark, tmp_path):
    own = counts(spark, tmp_path / "log")
    other = counts(spark, tmp_path / "log")
    made = []

    def change(state):
        if not made:
            other.commit(lambda _: {"n": 10})  # just before this one's entry is written
        made.append(state.get("n", 0))
        return {"n": 1}

    assert own.commit(change) == {"n": 11} and made == [0, 10]
    assert not own._put(f"{1:020}.entry", {"n": 99}) and other.state() == (2, {"n": 11})
    assert not [f for f in (tmp_path / "log").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]  # nothing left aside


def test_one_of_two_writers_closes_a_session(spark, tmp_path):
    one, other = (sessions.Archive(spark, str(tmp_path)) for _ in range(2))
    one.begin("s")
    one.publish("s")
    with pytest.raises(ValueError):
        other.discard("s")
    one.begin("t")
    with pytest.raises(ValueError):
        other.publish("t", "s")  # all or none
    assert other.state("t") == "waiting" and other.state("s") == "active"


def test_two_compactions(spark, tmp_path):
    archive = sessions.Archive(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a", False, 1)], "key int, value string, is_deleted boolean, ts int")
    archive.write(rows, archive.begin("s"), 1)
    archive.publish("s")
    other = sessions.Archive(spark, str(tmp_path))
    written = sessions.Archive.write

    def overtaken(self, *args, **named):
        written(self, *args, **named)
        if not getattr(overtaken, "done", False):
            overtaken.done = True
            other.compact()

    try:
        sessions.Archive.write = overtaken
        with pytest.raises(ValueError):
            archive.compact()
    finally:
        sessions.Archive.write = written
    states = [r.state for r in archive.states().collect()]
    assert sorted(states) == ["active", "discarded", "retired"]
    assert [(r.key, r.value) for r in archive.view().collect()] == [(1, "a")]


def test_a_stale_version_isnt_saved(spark, tmp_path):
    space = tables.Space(spark, str(tmp_path))
    space.define("t", "T", "k")
    space.save(tables.Table("t", ("k",), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")))
    mine, theirs = space.open("t"), space.open("t")
    space.save(theirs.update({"v": "x"}, k=1))
    with pytest.raises(log.Conflict):
        space.save(mine.update({"v": "y"}, k=2))
    again = space.save(space.open("t").update({"v": "y"}, k=2))
    assert sorted(map(tuple, again.rows.collect())) == [(1, "x"), (2, "y")]
    assert len([f for f in (tmp_path / "ts" / "T").iterdir() if f.is_dir()]) == 3  # what was refused is gone
