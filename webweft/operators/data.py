"""The accumulator that a chain fills: a small algebra of objects and arrays.

The typed plans don't need it; it states the rules that :func:`shape` follows when a typed
result is rendered the loose way, where one value stands for itself and several form an array.
"""

from __future__ import annotations

from typing import Any


class Data:
    """``value`` is unset (None), an object (dict) or an array (list)."""

    def __init__(self, value: Any = None, index: str | None = None):
        self.value, self.index = value, None
        if index is not None:
            self.set_index(index)

    def set_index(self, index: str) -> Data:
        """Name under which a merge puts this value; arrays keep none."""
        if not isinstance(self.value, list):
            self.index = index
        return self

    def set(self, key: str, value: Any) -> Data:
        """Set a key. A second value of a key makes it an array; an array root takes the value
        whatever the key; None is no value."""
        if value is None:
            return self
        if isinstance(self.value, list):
            self.value = [*self.value, value]
            return self
        now = dict(self.value or {})
        if key not in now:
            now[key] = value
        elif isinstance(now[key], list):
            now[key] = [*now[key], value]
        else:
            now[key] = [now[key], value]
        self.value = now
        return self

    def push(self, value: Any) -> Data:
        """Make the root an array (an object with keys becomes its first item) and append."""
        if not isinstance(self.value, list):
            self.value = [] if not self.value else [self.value]
        if value is not None:
            self.value = [*self.value, value]
        return self

    def extend(self, other: dict) -> Data:
        for key, value in other.items():
            self.set(key, value)
        return self

    def merge(self, child: Data) -> Data:
        """Take a child's value over: whole into an array, under its index, or key by key.
        A scalar without an index is dropped."""
        if child.value is None:
            return self
        if isinstance(self.value, list):
            return self.push(child.value)
        if child.index is not None:
            return self.set(child.index, child.value)
        return self.extend(child.value) if isinstance(child.value, dict) else self

    def is_empty(self) -> bool:
        return self.value is None or self.value == {}

    def child(self, index: str | None = None) -> Data:
        return Data(None, index)

    def clone(self) -> Data:
        """A copy that shares nothing with the original."""
        return Data(_copy(self.value), self.index)


def _copy(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _copy(v) for k, v in value.items()}
    return [_copy(v) for v in value] if isinstance(value, list) else value


def merge_all(values: list) -> Any:
    """What several results of one nested chain show as: nothing, the one itself, or an array."""
    values = [v for v in values if v is not None]
    return None if not values else values[0] if len(values) == 1 else values
