"""The operators of a chain, as immutable records, and how the local ones run on a document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from ..dom.selector import compile_selector
from .spec import Node, evaluate


@dataclass(frozen=True)
class Row:
    """A context with its data, and its ordinals along the chain."""

    node: Node
    data: dict
    order: tuple[int, ...] = ()


@dataclass(frozen=True)
class Step:
    """An operator. ``name`` is what error messages are prefixed with."""

    name = "step"
    local = True

    def run(self, row: Row, nested: bool, errors: list[str]) -> Iterator[Row]:
        yield row


@dataclass(frozen=True)
class Find(Step):
    """One row per node found: in the whole document, or relative to the context."""

    source: Any
    relative: bool = False
    name = "find"

    def __post_init__(self):
        for s in [] if callable(self.source) else [self.joined()]:
            compile_selector(s)

    def joined(self) -> str:
        return self.source if isinstance(self.source, str) else ", ".join(self.source)

    def run(self, row, nested, errors):
        source = self.source(row.node, row.data) if callable(self.source) else self.joined()
        if not isinstance(source, str):
            source = ", ".join(source)
        base = row.node if self.relative or nested else row.node.document()
        found = base.find(source)
        if not found:
            errors.append(f"(find) no results for \"{source}\"")
        for n in found:
            yield Row(n, row.data, (*row.order, n.index))


@dataclass(frozen=True)
class Set(Step):
    fields: dict
    name = "set"

    def run(self, row, nested, errors):
        data = dict(row.data)
        for key, spec in self.fields.items():
            value = evaluate(spec, row.node, row.data)
            if key in data:
                value = [v for x in (data[key], value) if x is not None for v in (x if isinstance(x, list) else [x])]
            data[key] = value
        yield Row(row.node, data, row.order)


@dataclass(frozen=True)
class SetArray(Step):
    """An array instead of an object as the data."""

    items: tuple
    name = "set"

    def run(self, row, nested, errors):
        yield Row(row.node, {"value": evaluate(list(self.items), row.node, row.data)}, row.order)


@dataclass(frozen=True)
class Keep(Step):
    """``filter``, ``success`` and ``fail``: rows with a match, or with none, below the context."""

    source: str
    kind: str = "filter"

    def __post_init__(self):
        compile_selector(self.source)

    @property
    def name(self):
        return self.kind

    def run(self, row, nested, errors):
        there = row.node.first(self.source) is not None
        if there != (self.kind == "fail"):
            yield row
        elif self.kind != "filter":
            errors.append(f"({self.kind}) {self.source} not found" if self.kind == "success" else f"(fail) found {self.source}")


@dataclass(frozen=True)
class Contains(Step):
    text: str
    name = "contains"

    def run(self, row, nested, errors):
        if self.text in row.node.text():
            yield row


@dataclass(frozen=True)
class Match(Step):
    pattern: str
    name = "match"

    def __post_init__(self):
        re.compile(self.pattern)

    def run(self, row, nested, errors):
        if re.search(self.pattern, row.node.text()):
            yield row


@dataclass(frozen=True)
class Then(Step):
    """A function of (node, data). Returning None passes the row on, with what it did to data;
    else it returns rows to go on with: nodes, or (node, data) pairs."""

    call: Any
    fields: dict = field(default_factory=dict)  # name: Spark type of what the function sets
    on_document: bool = False
    name = "then"

    def run(self, row, nested, errors):
        data = dict(row.data)
        out = self.call(row.node.document() if self.on_document else row.node, data)
        if out is None:
            yield Row(row.node, data, row.order)
            return
        for i, item in enumerate(out):
            node, own = item if isinstance(item, tuple) else (item, data)
            yield Row(node if node is not None else row.node, {**data, **(own or {})}, (*row.order, i))


@dataclass(frozen=True)
class Do(Step):
    """Run chains on the same context and take their objects' fields over."""

    chains: tuple
    name = "do"

    def run(self, row, nested, errors):
        data = dict(row.data)
        for chain in self.chains:
            if not chain.leaves_document:
                for value in chain.local_values(row.node):
                    if isinstance(value, dict):
                        for k, v in value.items():
                            many = chain.merged_many
                            if v is not None:
                                data[k] = [*(data.get(k) or []), v] if many and k in chain.fields else v
        yield Row(row.node, data, row.order)


@dataclass(frozen=True)
class Note(Step):
    """Operators that leave rows as they are: configuration, delays, taps."""

    kind: str
    value: Any = None

    @property
    def name(self):
        return self.kind


# ------------------------------------------------------------------------- requests


@dataclass(frozen=True)
class Request(Step):
    """Operators that load other documents. ``kind``: get, post, follow, submit, login, paginate."""

    kind: str
    target: Any = None
    params: Any = None
    limit: Any = None
    options: dict = field(default_factory=dict)
    local = False

    @property
    def name(self):
        return self.kind


def run_local(steps: tuple, row: Row, nested: bool, errors: list[str], at: int = 0, partial: bool = False) -> Iterator[Row]:
    """All rows that come out of a run of local steps; with ``partial`` also those that a step
    gives nothing for, as they were before it."""
    if at == len(steps):
        yield row
        return
    some = False
    for out in steps[at].run(row, nested, errors):
        some = True
        yield from run_local(steps, out, nested, errors, at + 1, partial)
    if partial and not some:
        yield row
