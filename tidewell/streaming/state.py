"""Keyed state for stateful processors: a value, a map, and a double-ended queue.

The accessors work on the handle that Spark gives ``StatefulProcessor.init``, and on ``LocalHandle``, which keeps state in
memory for tests. Where a name is shared by several keys Spark keeps these apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class ValueAccessor:
    """One value, or the default while there is none."""

    def __init__(self, handle, name: str, kind: str = "string", default: Any = None):
        self.state, self.default = handle.getValueState(name, f"value {kind}"), default

    def value(self) -> Any:
        return self.state.get()[0] if self.state.exists() else self.default

    def update(self, value: Any) -> None:
        self.state.update((value,))

    def clear(self) -> None:
        self.state.clear()


class MapAccessor:
    """Values by string key. ``size`` counts keys; removing an absent key changes nothing."""

    def __init__(self, handle, name: str, kind: str = "string"):
        self.state = handle.getMapState(name, "key string", f"value {kind}")

    def get(self, key: str, default: Any = None) -> Any:
        return self.state.getValue((key,))[0] if self.contains(key) else default

    def put(self, key: str, value: Any) -> None:
        self.state.updateValue((key,), (value,))

    def remove(self, key: str) -> None:
        if self.contains(key):
            self.state.removeKey((key,))

    def contains(self, key: str) -> bool:
        return self.state.containsKey((key,))

    def keys(self) -> Iterator[str]:
        return (k[0] for k in self.state.keys())

    def items(self) -> Iterator[tuple[str, Any]]:
        return ((k[0], v[0]) for k, v in self.state.iterator())

    def size(self) -> int:
        return sum(1 for _ in self.state.keys())

    def is_empty(self) -> bool:
        return self.size() == 0

    def clear(self) -> None:
        self.state.clear()


class DequeAccessor:
    """A double-ended queue whose ends are read and written without touching the rest.

    Elements are kept by place; places may be negative. Removing from an empty queue raises; peeking gives None.
    """

    def __init__(self, handle, name: str, kind: str = "string"):
        self.items = handle.getMapState(f"{name}_items", "place bigint", f"value {kind}")
        self.ends = handle.getValueState(f"{name}_ends", "front bigint, size bigint")

    def _ends(self) -> tuple[int, int]:
        return tuple(self.ends.get()) if self.ends.exists() else (0, 0)

    def add_first(self, value: Any) -> None:
        front, size = self._ends()
        self.items.updateValue((front - 1,), (value,))
        self.ends.update((front - 1, size + 1))

    def add_last(self, value: Any) -> None:
        front, size = self._ends()
        self.items.updateValue((front + size,), (value,))
        self.ends.update((front, size + 1))

    def _take(self, last: bool) -> Any:
        front, size = self._ends()
        if not size:
            raise IndexError("the queue is empty")
        place = front + size - 1 if last else front
        value = self.items.getValue((place,))[0]
        self.items.removeKey((place,))
        self.ends.update((front if last else front + 1, size - 1))
        return value

    def remove_first(self) -> Any:
        return self._take(False)

    def remove_last(self) -> Any:
        return self._take(True)

    def peek_first(self) -> Any:
        front, size = self._ends()
        return self.items.getValue((front,))[0] if size else None

    def peek_last(self) -> Any:
        front, size = self._ends()
        return self.items.getValue((front + size - 1,))[0] if size else None

    def value(self) -> list:
        front, size = self._ends()
        return [self.items.getValue((i,))[0] for i in range(front, front + size)]

    def update(self, values: list) -> None:
        self.clear()
        for v in values:
            self.add_last(v)

    def size(self) -> int:
        return self._ends()[1]

    def is_empty(self) -> bool:
        return self.size() == 0

    def clear(self) -> None:
        self.items.clear()
        self.ends.clear()


class _Value:
    def __init__(self):
        self.held = None

    def exists(self) -> bool:
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value) -> None:
        self.held = value

    def clear(self) -> None:
        self.held = None


class _Map:
    def __init__(self):
        self.held: dict = {}

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value) -> None:
        self.held[key] = value

    def removeKey(self, key) -> None:
        self.held.pop(key, None)

    def containsKey(self, key) -> bool:
        return key in self.held

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter(list(self.held.items()))

    def clear(self) -> None:
        self.held.clear()


class LocalHandle:
    """State in memory, by name, of one key."""

    def __init__(self):
        self.held: dict = {}

    def getValueState(self, name: str, schema: str) -> _Value:
        return self.held.setdefault(name, _Value())

    def getMapState(self, name: str, key_schema: str, value_schema: str) -> _Map:
        return self.held.setdefault(name, _Map())


def inspect(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The state of a stopped or running query, read from its checkpoint."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
