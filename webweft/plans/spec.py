"""What ``set`` takes: field specifications, their types, and how they are evaluated on a node."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from ..dom.selector import Ref, compile_selector
from ..dom.tree import Document
from ..functions.urls import strip


@dataclass(frozen=True)
class Fn:
    """A Python function of (node, data) with the type of what it returns."""

    call: Callable[[Any, dict], Any]
    returns: T.DataType = T.StringType()  # noqa: RUF009


class _Position:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name


#: Fields with a node's place among those found with it, and whether it is the last of them.
INDEX, LAST = _Position("INDEX"), _Position("LAST")


class Node:
    """What functions get to see of a context: a node of a parsed document, or an attribute."""

    __slots__ = ("doc", "ref", "index", "last")

    def __init__(self, doc: Document, ref: Ref, index: int = 0, last: bool = True):
        self.doc, self.ref, self.index, self.last = doc, ref, index, last

    @property
    def name(self) -> str:
        return self.ref[1] or self.doc.name[self.ref[0]]

    @property
    def url(self) -> str | None:
        return self.doc.url

    def text(self) -> str:
        node, attr = self.ref
        return self.doc.text(node) if attr is None else self.doc.attrs[node].get(attr, "")

    def content(self) -> str:
        return strip(self.text())

    def attr(self, name: str) -> str | None:
        return self.doc.attrs[self.ref[0]].get(name)

    def find(self, selector: str) -> list[Node]:
        found = compile_selector(selector).find(self.doc, self.ref[0])
        return [Node(self.doc, r, i, i == len(found) - 1) for i, r in enumerate(found)]

    def first(self, selector: str) -> Node | None:
        return next(iter(self.find(selector)), None)

    def outer(self) -> str:
        return self.text() if self.ref[1] else self.doc.outer(self.ref[0])

    def inner(self) -> str:
        return self.text() if self.ref[1] else self.doc.inner(self.ref[0])

    def document(self) -> Node:
        return Node(self.doc, (0, None))


def is_chain(spec: Any) -> bool:
    return hasattr(spec, "steps") and hasattr(spec, "result_type")


def has_remote(spec: Any) -> bool:
    """Whether a specification leaves its document somewhere."""
    if is_chain(spec):
        return spec.leaves_document
    if isinstance(spec, dict):
        return any(map(has_remote, spec.values()))
    return isinstance(spec, (list, tuple)) and any(map(has_remote, spec))


def type_of(spec: Any) -> T.DataType:
    """Spark type of a field; arrays of unlike items hold JSON strings."""
    if spec is None or isinstance(spec, str):
        if isinstance(spec, str):
            compile_selector(split_suffix(spec)[0])
        return T.StringType()
    if isinstance(spec, _Position):
        return T.LongType() if spec.name == "INDEX" else T.BooleanType()
    if isinstance(spec, Fn):
        return spec.returns
    if is_chain(spec):
        return T.ArrayType(spec.result_type)
    if isinstance(spec, dict):
        return T.StructType([T.StructField(k, type_of(v)) for k, v in spec.items()])
    if isinstance(spec, (list, tuple)):
        items = [type_of(s).elementType if is_chain(s) else type_of(s) for s in spec]
        return T.ArrayType(items[0] if items and all(i == items[0] for i in items) else T.StringType())
    if callable(spec):
        return T.StringType()
    raise TypeError(f"a field can't be {spec!r}")


def split_suffix(source: str) -> tuple[str, str]:
    for suffix in (":source", ":html"):
        if source.endswith(suffix):
            return source[: -len(suffix)], suffix
    return source, ""


def evaluate(spec: Any, node: Node, data: dict) -> Any:
    """A field's value, None if there is none. Fields that leave the document are left to the plan."""
    if spec is None:
        return node.content()
    if isinstance(spec, str):
        source, suffix = split_suffix(spec)
        found = node.first(source)
        if found is None:
            return None
        return found.outer() if suffix == ":source" else found.inner() if suffix == ":html" else found.content()
    if isinstance(spec, _Position):
        return node.index if spec.name == "INDEX" else node.last
    if isinstance(spec, Fn):
        return _returned(spec.call(node, data))
    if is_chain(spec):
        return None if spec.leaves_document else spec.local_values(node)
    if isinstance(spec, dict):
        out = {k: evaluate(v, node, data) for k, v in spec.items()}
        return out if any(v is not None and v != [] for v in out.values()) else None
    if isinstance(spec, (list, tuple)):
        return _items(spec, node, data)
    return _returned(spec(node, data))


def _returned(value: Any) -> Any:
    return value.content() if isinstance(value, Node) else value


def _items(specs: list | tuple, node: Node, data: dict) -> list:
    """Items of an array: all matches of each selector and all results of each chain, flat."""
    mixed = isinstance(type_of(specs).elementType, T.StringType) and any(not isinstance(s, str) for s in specs)
    out: list = []
    for s in specs:
        if isinstance(s, str):
            out += [n.content() for n in node.find(s)]
            continue
        value = evaluate(s, node, data)
        values = value or [] if is_chain(s) else [] if value is None else [value]
        out += [v if isinstance(v, str) or not mixed else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values]
    return out


def shape(value: Any, spec: Any) -> Any:
    """A typed value the loose way: absent fields are left out, and a chain's results are
    nothing, the one itself, or an array."""
    if value is None:
        return None
    if is_chain(spec):
        inner = spec.fields
        values = [shape(v, inner) if inner else v for v in value]
        values = [v for v in values if v is not None]
        return None if not values else values[0] if len(values) == 1 else values
    if isinstance(spec, dict):
        row = value.asDict() if hasattr(value, "asDict") else value
        out = {k: s for k, f in spec.items() if (s := shape(row.get(k), f)) is not None}
        return out or None
    if isinstance(spec, (list, tuple)) and len(spec) == 1 and isinstance(spec[0], (dict, list, tuple)):
        return [s for v in value if (s := shape(v, spec[0])) is not None]
    return value
