import json
import os
import random

import pytest
from pyspark.sql import functions as F

from assayframe.operators import status, transcripts
from assayframe.sources import documents, files
from assayframe.streaming import status as states
from assayframe.streaming import transcripts as turns
from assayframe.streaming.upsert import UpsertTable


def _table(spark, path):
    return UpsertTable(spark, str(path), ("k",), "seq", "k int, seq bigint, v string", 4)


def _rows(spark, rows):
    return spark.createDataFrame(rows, "k int, seq bigint, v string")


def test_upsert_replay_and_vacuum(spark, tmp_path):
    table = _table(spark, tmp_path / "t")
    assert table.read().count() == 0
    assert table.upsert(_rows(spark, [(1, 1, "a"), (1, 3, "c"), (2, 1, "x")]), 0)
    assert table.upsert(_rows(spark, [(1, 2, "late"), (3, 1, "y")]), 1)
    assert not table.upsert(_rows(spark, [(1, 9, "again")]), 1) and not table.upsert(_rows(spark, [(9, 9, "old")]), 0)
    want = [(1, 3, "c"), (2, 1, "x"), (3, 1, "y")]
    assert sorted(map(tuple, table.read().collect())) == want
    assert table.upsert(_rows(spark, []), 2)
    table.vacuum()
    assert sorted(map(tuple, _table(spark, tmp_path / "t").read().collect())) == want and len(os.listdir(tmp_path / "t" / "manifest")) in (1, 2)


def test_upsert_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    table = _table(spark, tmp_path / "t")
    table.upsert(_rows(spark, [(1, 1, "a")]), 0)
    monkeypatch.setattr(UpsertTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.upsert(_rows(spark, [(1, 2, "b")]), 1)
    monkeypatch.undo()
    assert table.read().first()["v"] == "a"
    table.upsert(_rows(spark, [(1, 2, "b")]), 1)
    assert table.read().first()["v"] == "b"
    table.vacuum()
    assert len([d for d in os.listdir(tmp_path / "t" / "data") if not d.startswith(".")]) == 1


def test_states_equal_the_batch_operator(spark, tmp_path):
    rng, log = random.Random(1), []
    folder = tmp_path / "events"
    folder.mkdir()
    for n in range(4):
        part = [{"case_idx": rng.randrange(6), "iteration": rng.randrange(2), "state": rng.choice(["pending", "running", "done"]), "passed": rng.random() < 0.5, "seq": 100 * n + i} for i in range(20)]
        log += part
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, part)) + "\nbroken\n")
    events = lambda: states.read_events(spark, str(folder), files_per_batch=1)
    states.keep_states(events(), str(tmp_path / "t"), str(tmp_path / "c"), buckets=4).awaitTermination()
    table = states.state_table(spark, str(tmp_path / "t"), 4)
    got = sorted(tuple(r) for r in table.read().select("case_idx", "iteration", "state", "passed").collect())
    whole = spark.createDataFrame([tuple(e.values()) for e in log], "case_idx int, iteration int, state string, passed boolean, seq bigint")
    assert got == sorted(map(tuple, status.latest_state(whole).collect()))
    # without its checkpoint the stream begins again at batch 0: every batch is known
    states.keep_states(events(), str(tmp_path / "t"), str(tmp_path / "c2"), buckets=4).awaitTermination()
    assert sorted(tuple(r) for r in table.read().select("case_idx", "iteration", "state", "passed").collect()) == got


def _line(kind, **more):
    return json.dumps({"type": kind} | more)


def _turn_lines(i):
    text = lambda t: _line("assistant", message={"content": [{"type": "text", "text": t}]})
    tool = _line("assistant", message={"content": [{"type": "tool_use", "name": "Bash", "input": {"n": i}}]})
    return [_line("system", subtype="init", session_id=f"s{i}"), text(f"héllo {i} "), "{broken", tool, text("bye"), _line("result", result="r")]


@pytest.mark.parametrize("partition_bytes", [64, 1 << 20])
def test_growing_files_are_read_once_and_by_whole_lines(spark, tmp_path, partition_bytes):
    reader = files._LineReader({"path": str(tmp_path), "partitionBytes": str(partition_bytes)})
    texts = {f"f{i}.jsonl": "".join(x + "\n" for x in _turn_lines(i)) for i in range(3)}
    rng, done, seen = random.Random(2), reader.initialOffset(), {n: [] for n in texts}
    sizes = dict.fromkeys(texts, 0)
    while any(sizes[n] < len(t.encode()) for n, t in texts.items()):
        for n, t in texts.items():
            sizes[n] = min(len(t.encode()), sizes[n] + rng.randrange(90))
            (tmp_path / n).write_bytes(t.encode()[: sizes[n]])
        latest = reader.latestOffset()
        for part in reader.partitions(done, latest):
            for batch in reader.read(part):
                for r in batch.to_pylist():
                    assert texts[r["file"]].encode()[r["line_no"] :].startswith(r["raw"].encode() + b"\n")
                    seen[r["file"]].append(r["raw"])
        done = latest
    assert seen == {n: t.split("\n")[:-1] for n, t in texts.items()}


def test_turns_of_growing_files_equal_the_batch_operator(spark, tmp_path):
    files.register(spark)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    folder = tmp_path / "runs"
    folder.mkdir()
    names = {f"task{i}.{t}.jsonl": "".join(x + "\n" for x in _turn_lines(10 * i + t)) for i in range(3) for t in range(2)}
    lines = lambda: spark.readStream.format("lines").load(str(folder))
    with pytest.raises(ValueError):
        spark.conf.unset(key)
        turns.follow(lines(), str(tmp_path / "t"), str(tmp_path / "c"))
    spark.conf.set(key, turns.STORE)
    try:
        for share in (0.3, 0.7, 1.0):
            for n, t in names.items():
                (folder / n).write_bytes(t.encode()[: int(len(t.encode()) * share)])
            query = turns.follow(lines(), str(tmp_path / "t"), str(tmp_path / "c"), idle=3600)
            query.awaitTermination()
            table = turns.turn_table(spark, str(tmp_path / "t"))
            assert share == 1.0 or table.read().count() == 0
        kept = query.lastProgress.stateOperators[0].numRowsTotal
    finally:
        spark.conf.set(key, before)
    assert kept == 0  # finished turns leave nothing
    got = {(r["task_key"], r["turn"]): (r["text"], r["tool_calls"], r["session_id"]) for r in table.read().collect()}
    batch = transcripts.block_stream(documents.load_transcripts(spark, str(folder)))
    assert got == {(r["task_key"], r["turn"]): (r["text"], r["tool_calls"], r["session_id"]) for r in batch.collect()} and len(got) == 6
    assert table.read().where("not ended").count() == 0


def test_idle_turns_are_released(spark):
    """The processor by itself: a turn that stopped is given up when its timer runs out."""

    class State:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value if self.value is not None else iter(())

        def update(self, value):
            self.value = value

        def appendList(self, rows):
            self.value = [*(self.value or []), *rows]

        def clear(self):
            self.value = None

    class Handle:
        timers: list = []

        def getListState(self, *a):
            return State()

        def getValueState(self, *a):
            return State()

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 50

    import pandas as pd

    own, handle = turns._Turns(1000), Handle()
    own.init(handle)
    part = lambda n: pd.DataFrame({"line_no": [n], "raw": [f"x{n}"], "ends": [False]})
    assert list(own.handleInputRows(("k", 0), [part(2)], Now())) == [] == list(own.handleInputRows(("k", 0), [part(1)], Now()))
    assert handle.timers == [1050]
    (out,) = own.handleExpiredTimer(("k", 0), Now(), None)
    assert out["lines"][0] == [{"line_no": 1, "raw": "x1"}, {"line_no": 2, "raw": "x2"}] and not out["ended"][0] and handle.timers == [] and not own.lines.exists()
