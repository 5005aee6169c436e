"""A checkpointed task graph: the control plane runs on the driver, the data stays in Parquet."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter


@dataclass(frozen=True)
class Task:
    """``run`` takes the outputs of the tasks it is ``after``, by name, and returns a JSON-able output."""

    name: str
    after: tuple[str, ...]
    run: Callable[[dict[str, dict]], dict]


@dataclass
class Outcome:
    executed: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


class SimulatedCrash(RuntimeError):
    """Raised on request right after a task was marked done."""


def in_order(tasks: list[Task]) -> list[str]:
    """Names so that each comes after what it needs, and as declared where that is free.

    An unknown predecessor is a KeyError; a cycle a ValueError.
    """
    place = {t.name: i for i, t in enumerate(tasks)}
    sorter = TopologicalSorter({t.name: [] for t in tasks})
    for t in tasks:
        for a in t.after:
            if a not in place:
                raise KeyError(f"{t.name} comes after {a}, which is no task")
            sorter.add(t.name, a)
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"the tasks form a cycle: {e.args[1]}") from e
    out, ready = [], []
    while sorter.is_active():
        ready = sorted([*ready, *sorter.get_ready()], key=place.__getitem__)
        out.append(ready.pop(0))
        sorter.done(out[-1])
    return out


def _put(path: str, value: dict) -> None:
    """Write JSON so that a reader sees the old file or the new one, never a part."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True)
    os.replace(f"{path}.tmp", path)


def _get(path: str, default: dict | None = None) -> dict:
    if default is not None and not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Graph:
    """Runs tasks in ``run_dir``; a task that is marked done there is skipped and its output reused.

    A task's output is written before it is marked, so a crash between the two runs it again:
    tasks run at least once, and have to be idempotent.
    """

    def __init__(self, run_dir: str, tasks: list[Task]):
        self.run_dir, self.tasks = run_dir, {t.name: t for t in tasks}
        self.order = in_order(tasks)

    def output(self, name: str) -> dict:
        return _get(os.path.join(self.run_dir, "outputs", f"{name}.json"))

    def done(self) -> list[str]:
        return list(_get(os.path.join(self.run_dir, "checkpoints.json"), {"done": []})["done"])

    def run(self, crash_after: str | None = None) -> Outcome:
        done, outcome = self.done(), Outcome()
        for name in self.order:
            if name in done:
                outcome.skipped.append(name)
                continue
            task = self.tasks[name]
            result = task.run({a: self.output(a) for a in task.after})
            _put(os.path.join(self.run_dir, "outputs", f"{name}.json"), result)
            done.append(name)
            _put(os.path.join(self.run_dir, "checkpoints.json"), {"done": done})
            outcome.executed.append(name)
            if name == crash_after:
                raise SimulatedCrash(name)
        return outcome
