"""Steps of composed flows: who reads them, when they are written, how queries share them.

A flow is a class whose steps are methods marked `@step`; READS names the steps that each reads.
From the steps a query asks for follows how often every other one is read. A step with one reader
stays part of the reader's plan, where Catalyst sees through it; one with two or more is written
once. Flows of one kind over the same inputs - equal logical plans over the same files - share their
steps, also between queries: a step that an earlier query has asked for counts as read before.

Written steps last until `session.release` or the end of the outermost `lease`. The files of an
input are part of what a step is known by, so a table that was written anew gives new steps."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cohortloom import session

ENOUGH = 2  # readers for which a step is written


def reader_counts(reads: dict[str, tuple[str, ...]], targets: Iterable[str]) -> Counter:
    """How often each step is read for the targets, each of which its caller reads once."""
    counts, seen, todo = Counter(targets), set(), list(targets)
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            counts.update(reads.get(name, ()))
            todo.extend(reads.get(name, ()))
    return counts


def input_files(df: DataFrame) -> tuple:
    """What the file inputs of a plan are now: number, names, bytes and times, by input."""
    found = []
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            at = leaf.relation().location()
            roots = at.rootPaths()
            times = tuple(roots.apply(k).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
                          .getFileStatus(roots.apply(k)).getModificationTime() for k in range(roots.size()))
            listed = at.getClass().getSimpleName() == "InMemoryFileIndex"  # its files are known already
            names = at.allFiles().hashCode() if listed else hash(tuple(at.inputFiles()))
            found.append((names, at.sizeInBytes(), times))
    return tuple(found)


@dataclass
class Shelf:
    """The steps of all flows of one kind over the same inputs."""

    kind: type
    settings: dict
    frames: dict[str, DataFrame]
    files: dict[str, tuple]
    requests: Counter = field(default_factory=Counter)
    written: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)  # path and table
    made: dict[str, object] = field(default_factory=dict)

    def serves(self, other: Shelf) -> bool:
        return (self.kind is other.kind and self.settings == other.settings and self.files == other.files
                and all(df.sameSemantics(other.frames[k]) for k, df in self.frames.items()))


_shelves: list[Shelf] = []
session.on_release(_shelves.clear)


def _flat(inputs: dict) -> dict:
    out = {}
    for name, value in inputs.items():
        out |= {f"{name}.{k}": v for k, v in value.items()} if isinstance(value, dict) else {name: value}
    return out


def shelf_of(kind: type, inputs: dict) -> Shelf:
    flat = _flat(inputs)
    frames = {k: v for k, v in flat.items() if isinstance(v, DataFrame)}
    new = Shelf(kind, {k: repr(v) for k, v in flat.items() if k not in frames}, frames,
                {k: input_files(df) for k, df in frames.items()})
    for shelf in _shelves:
        if next(iter(shelf.frames.values())).sparkSession is next(iter(frames.values())).sparkSession and shelf.serves(new):
            return shelf
    _shelves.append(new)
    return new


class Flow:
    """Base of the composed flows. `Flow(**inputs)` is all lazy; `Flow.stored(targets, **inputs)` shares
    steps with other flows and writes those with several readers."""

    READS: dict[str, tuple[str, ...]] = {}
    _shelf: Shelf | None = None
    _readers: Counter = Counter()

    @classmethod
    def stored(cls, targets: Iterable[str] | str, **inputs):
        flow = cls(**inputs)
        flow._shelf = shelf_of(cls, inputs)
        flow._readers = reader_counts(cls.READS, [targets] if isinstance(targets, str) else targets)
        return flow

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self._shelf is None:
            return make()
        shelf = self._shelf
        shelf.requests[name] += max(1, self._readers[name])
        if name in shelf.written and session.is_there(self._spark(), shelf.written[name][0]):
            return shelf.written[name][1]
        df = make()
        if shelf.requests[name] < ENOUGH:
            return df
        path = session.write_step(df, name)
        shelf.written[name] = path, df.sparkSession.read.schema(df.schema).parquet(path)
        return shelf.written[name][1]

    def _spark(self) -> SparkSession:
        return next(iter(self._shelf.frames.values())).sparkSession


    def once(self, name: str, make: Callable[[], object]) -> object:
        """Something other than a table - a fitted model - that flows over the same inputs share."""
        if self._shelf is None:
            return make()
        if name not in self._shelf.made:
            self._shelf.made[name] = make()
        return self._shelf.made[name]


def step(make: Callable[[Flow], DataFrame]) -> cached_property:
    """A step of a flow: built once, kept by the flow's rules."""

    def get(self: Flow) -> DataFrame:
        return self.keep(make.__name__, lambda: make(self))

    get.__doc__ = make.__doc__
    return cached_property(get)


_leases = 0


@contextmanager
def lease(spark: SparkSession):
    """Within it queries share written steps; at the end of the outermost one all are removed."""
    global _leases
    _leases += 1
    try:
        yield
    finally:
        _leases -= 1
        if not _leases:
            session.release(spark)
