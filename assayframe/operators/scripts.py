"""Setup and teardown scripts around tasks, run in the Spark task that answers.

A task's home is a new folder that its setup, its call and its teardown share, so all three are one step of one Spark task: rows
stream through ``mapInArrow``, each with its scripts around it. Every script is the leader of a process group of its own; what it leaves running
in the background (a server that the call needs) lives until the task's teardown is over, and then the group is killed. A script that
takes longer than the limit is killed with all it started.

Side effects are at least once: Spark may run a task again where an executor was lost. Each attempt starts from a new home, so what a lost attempt
left half done is not seen, and scripts are told the attempt in ``CASE_ATTEMPT``. Homes lie in the executor's own temporary folder on purpose; nothing
in them is read by another task, and they are removed with the row, also when the call raises or the task is cancelled.
"""

from __future__ import annotations

import os
import shutil
import signal
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

TIMEOUT = 30.0
#: bytes of a script's output that are told, from its end
TOLD = 1 << 16

CALLS = "array<struct<name:string,input:string>>"
#: what ``around`` adds to a task
ADDED = f"response string, tool_calls {CALLS}, script_error string, call_error string, teardown_error string"
_ARROW_CALLS = pa.list_(pa.struct([("name", pa.string()), ("input", pa.string())]))
_ARROW = {"response": pa.string(), "tool_calls": _ARROW_CALLS, "script_error": pa.string(), "call_error": pa.string(), "teardown_error": pa.string()}

#: what a call gives for a task: (response, [(tool name, input as JSON)])
Ask = Callable[[dict, str], tuple[str | None, list[tuple[str, str]]]]


@dataclass
class Home:
    """A folder for one task, and the process groups that its scripts started."""

    path: str
    groups: list[int] = field(default_factory=list)

    def script(self, text: str, cwd: str | None, timeout: float, attempt: int) -> tuple[int, str]:
        """(exit status, output) of a script; -1 where it was killed for its time."""
        env = os.environ | {"HOME": self.path, "CASE_ATTEMPT": str(attempt)}
        with tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:  # pipes would wait for what runs on in the background
            run = subprocess.Popen(["bash", "-c", text], env=env, cwd=cwd or None, stdin=subprocess.DEVNULL, stdout=out, stderr=err, start_new_session=True)
            self.groups.append(run.pid)
            try:
                status = run.wait(timeout)
            except subprocess.TimeoutExpired:
                _kill(run.pid)
                run.wait()
                return -1, f"Script timed out after {timeout:g}s"
            return status, _tail(err) or _tail(out)

    def close(self) -> None:
        for group in self.groups:
            _kill(group)
        shutil.rmtree(self.path, ignore_errors=True)


def _kill(group: int) -> None:
    with suppress(ProcessLookupError, PermissionError):
        os.killpg(group, signal.SIGKILL)


def _tail(file) -> str:
    size = file.seek(0, os.SEEK_END)
    file.seek(max(0, size - TOLD))
    return file.read().decode("utf-8", "replace")


def run_task(task: dict, ask: Ask, cwd: str | None = None, timeout: float = TIMEOUT, attempt: int = 0) -> dict:
    """One task: setup, call, teardown. After a failed setup neither follows; a failed call is followed by the teardown, whose failure is only told."""
    out: dict = dict.fromkeys(_ARROW)
    home = Home(tempfile.mkdtemp(prefix="case-home-"))
    try:
        if task.get("setup"):
            status, said = home.script(task["setup"], cwd, timeout, attempt)
            if status:
                return out | {"script_error": f"Setup failed (exit {status}): {said}"}
        try:
            response, calls = ask(task, home.path)
            out |= {"response": response, "tool_calls": [{"name": n, "input": i} for n, i in calls]}
        except Exception as e:
            out["call_error"] = f"Error ({type(e).__name__}): {e}"
        finally:
            if task.get("teardown"):
                status, said = home.script(task["teardown"], cwd, timeout, attempt)
                if status:
                    out["teardown_error"] = f"Teardown failed (exit {status}): {said}"
    finally:
        home.close()
    return out


def recorded(task: dict, home: str) -> tuple[str | None, list[tuple[str, str]]]:
    """The answer that a task's row brings with it."""
    return task.get("response"), [(c["name"], c["input"]) for c in task.get("tool_calls") or ()]


def around(tasks: DataFrame, ask: Ask = recorded, *, cwd: str | None = None, timeout: float = TIMEOUT, parallel: int | None = None) -> DataFrame:
    """tasks with their answers and what went wrong (ADDED), each run with its scripts.

    ``ask(task, home)`` is called in the executor; ``parallel`` says over how many Spark tasks the rows are dealt. The result is to be
    kept (``sources.results.kept``) before it is used twice, for every use runs the scripts again.
    """
    if parallel:
        tasks = tasks.repartition(parallel)
    names = tasks.columns
    rest = [c for c in names if c not in _ARROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().attemptNumber()
        for batch in batches:
            for i in range(batch.num_rows):  # one row at a time: what has run is handed on before the next starts
                row = batch.slice(i, 1)
                got = run_task(row.to_pylist()[0], ask, cwd, timeout, attempt)
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in rest], *[pa.array([got[c]], kind) for c, kind in _ARROW.items()]], [*rest, *_ARROW])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields if f.name in rest)
    return tasks.mapInArrow(run, f"{kept}, {ADDED}")
