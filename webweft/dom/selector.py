"""Selectors that mix CSS and XPath: compiled once, evaluated on node arrays.

Understood are: names, ``*``, ``#id``, ``.class``; the combinators blank, ``>``, ``+``, ``~``,
``/`` and ``//``; axes (``following::``); attribute tests in CSS or XPath spelling, positions,
and boolean expressions in brackets; ``@attribute`` selection; unions by commas; and the pseudo
classes of :data:`PSEUDO`. Positions count per parent, as in XPath. Anything else raises
:class:`SelectorError` when the selector is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from urllib.parse import urljoin, urlsplit

from .tree import DOCUMENT, ELEMENT, TEXT_NODE, Document

#: A node id and, for an attribute, its name.
Ref = tuple[int, str | None]
Test = Callable[[Document, int, int, int], bool]

PSEUDO = (
    "first last skip-last first-child last-child only-child nth-child empty odd even contains starts-with has not before after "
    "internal external domain path checked selected disabled enabled"
).split()
AXES = (
    "child descendant descendant-or-self self parent ancestor ancestor-or-self following preceding following-sibling preceding-sibling attribute"
).split()


class SelectorError(ValueError):
    """A selector that cannot be understood."""


# ------------------------------------------------------------------------ axes


def _axis(doc: Document, node: int, axis: str) -> list[int]:
    """Nodes on an axis, nearest first where that matters for positions."""
    if axis == "child":
        return doc.children[node]
    if axis == "descendant":
        return list(range(node + 1, doc.last[node] + 1))
    if axis == "descendant-or-self":
        return list(range(node, doc.last[node] + 1))
    if axis == "self":
        return [node]
    if axis == "parent":
        return [doc.parent[node]] if doc.parent[node] >= 0 else []
    if axis == "ancestor":
        return doc.ancestors(node)
    if axis == "ancestor-or-self":
        return [node, *doc.ancestors(node)]
    if axis == "following":
        return list(range(doc.last[node] + 1, len(doc.kind)))
    if axis == "preceding":
        above = {node, 0, *doc.ancestors(node)}
        return [i for i in range(node - 1, 0, -1) if i not in above]
    beside = doc.children[doc.parent[node]] if doc.parent[node] >= 0 else []
    at = beside.index(node) if node in beside else 0
    return beside[at + 1 :] if axis == "following-sibling" else beside[:at][::-1]


class Step:
    """One step: an axis, a node test, and conditions in order."""

    def __init__(self, axis: str, name: str, tests: list[Test], deep: bool = False):
        self.axis, self.name, self.tests, self.deep = axis, name, tests, deep

    def is_named(self, doc: Document, node: int) -> bool:
        kind = doc.kind[node]
        if self.name == "node()":
            return True
        if self.name == "text()":
            return kind == TEXT_NODE
        if self.name == "element-or-document":
            return kind != TEXT_NODE
        return kind == ELEMENT and (self.name in ("*", "") or doc.name[node] == self.name)

    def keep(self, doc: Document, nodes: list[int]) -> list[int]:
        for test in self.tests:
            size = len(nodes)
            nodes = [n for i, n in enumerate(nodes, 1) if test(doc, n, i, size)]
        return nodes

    def matches(self, doc: Document, node: int) -> bool:
        """Whether a node is one that this step describes; without a name any kind of node may be."""
        return (self.name == "" or self.is_named(doc, node)) and all(t(doc, node, 1, 1) for t in self.tests)

    def run(self, doc: Document, refs: list[Ref]) -> list[Ref]:
        if self.axis == "attribute":
            sources = [n for n, a in refs if a is None]
            if self.deep:
                sources = sorted({i for n in sources for i in range(n, doc.last[n] + 1)})
            return [(n, a) for n in sources for a in doc.attrs[n] if self.name in ("*", a)]
        found: set[int] = set()
        for n, a in refs:
            if a is not None and self.axis not in ("self", "parent"):
                continue
            if self.deep and self.axis == "child":
                groups: dict[int, list[int]] = {}
                for i in range(n + 1, doc.last[n] + 1):
                    if self.is_named(doc, i):
                        groups.setdefault(doc.parent[i], []).append(i)
                for own in groups.values():
                    found.update(self.keep(doc, own))
            else:
                starts = range(n, doc.last[n] + 1) if self.deep else (n,)
                for start in starts:
                    found.update(self.keep(doc, [i for i in _axis(doc, start, self.axis) if self.is_named(doc, i)]))
        return [(i, None) for i in sorted(found)]


class Path:
    def __init__(self, steps: list[Step], absolute: bool):
        self.steps, self.absolute = steps, absolute

    def run(self, doc: Document, node: int) -> list[Ref]:
        refs: list[Ref] = [(0 if self.absolute else node, None)]
        for step in self.steps:
            refs = step.run(doc, refs)
        return refs


class Selector:
    """``find(doc, node)``: what a selector finds under a node, in document order, each once."""

    def __init__(self, source: str, paths: list[Path]):
        self.source, self.paths = source, paths

    def find(self, doc: Document, node: int = 0) -> list[Ref]:
        if len(self.paths) == 1:
            return self.paths[0].run(doc, node)
        return sorted({r for p in self.paths for r in p.run(doc, node)}, key=lambda r: (r[0], r[1] or ""))

    def first(self, doc: Document, node: int = 0) -> Ref | None:
        found = self.find(doc, node)
        return found[0] if found else None


# ---------------------------------------------------------------------- parser

_NAME = re.compile(r"[A-Za-z_](?:[\w-]|:(?!:)(?=\w)(?<!:))*(?<!:)|[A-Za-z_][\w-]*")
_IDENT = re.compile(r"[A-Za-z_][\w-]*")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
_STRING = re.compile(r"\"([^\"]*)\"|'([^']*)'")
_SPACE = re.compile(r"\s*")


class _Parser:
    def __init__(self, source: str, raw: bool):
        self.s, self.i, self.raw = source, 0, raw

    # -- small things

    def fail(self, what: str):
        raise SelectorError(f"{what} at {self.i} in selector {self.s!r}")

    def space(self) -> bool:
        start = self.i
        self.i = _SPACE.match(self.s, self.i).end()
        return self.i > start

    def at(self, text: str) -> bool:
        return self.s.startswith(text, self.i)

    def take(self, text: str) -> bool:
        if self.at(text):
            self.i += len(text)
            return True
        return False

    def need(self, text: str) -> None:
        self.space()
        if not self.take(text):
            self.fail(f"{text!r} expected")

    def match(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.s, self.i)
        if m:
            self.i = m.end()
        return m

    def ident(self) -> str:
        m = self.match(_IDENT)
        return m.group() if m else self.fail("a name expected")

    def string(self) -> str:
        m = self.match(_STRING)
        if not m:
            self.fail("a string expected")
        return m[1] if m[1] is not None else m[2]

    # -- paths

    def union(self, end: str = "") -> list[Path]:
        paths = [self.path(end)]
        while True:
            self.space()
            if self.take(",") or self.take("|"):
                paths.append(self.path(end))
            else:
                break
        if not end and self.i < len(self.s):
            self.fail("the end expected")
        return paths

    def path(self, end: str = "", relative: bool = False) -> Path:
        """A path; in an XPath expression (``relative``) blanks end it."""
        self.space()
        steps: list[Step] = []
        absolute = False
        deep, axis = not relative, "child"
        if self.take("//"):
            absolute, deep = self.raw and not relative, True
        elif self.take("/"):
            absolute, deep = True, False
        elif self.take(">"):
            deep = False
        elif self.take("+"):
            deep, axis = False, "adjacent"
        self.space()
        while True:
            steps += self.step(axis, deep)
            blank = self.space() if not relative else False
            if self.i >= len(self.s) or self.s[self.i] in ",)|" or end and self.at(end) or relative and not self.at("/"):
                break
            axis, deep = "child", False
            if self.take("//"):
                deep = True
            elif self.take("/") or self.take(">"):
                pass
            elif self.take("+"):
                axis = "adjacent"
            elif self.take("~"):
                axis = "following-sibling"
            elif blank:
                deep = True
            elif self.at("@"):
                pass
            else:
                self.fail("a combinator expected")
            self.space()
        return Path(steps, absolute)

    def step(self, axis: str, deep: bool) -> list[Step]:
        before: list[Step] = []
        tests: list[Test] = []
        name = ""
        m = re.compile(r"([a-z-]+)::").match(self.s, self.i)
        if m:
            if m[1] not in AXES:
                self.fail(f"unknown axis {m[1]!r}")
            self.i = m.end()
            if deep and m[1] in ("following", "preceding", "ancestor", "ancestor-or-self", "self", "parent", "descendant", "descendant-or-self", "following-sibling", "preceding-sibling"):
                # `a b::c` means the axis from a itself; `a//b::c` from all nodes inside as well
                deep = self.s[: m.start()].rstrip().endswith("//")
            axis = m[1]
            if axis == "attribute":
                return [Step("attribute", "*" if self.take("*") else self.ident(), [], deep)]
        if self.take("@"):
            return [Step("attribute", "*" if self.take("*") else self.ident().lower(), [], deep)]
        if self.take(".."):
            return [Step("parent", "element-or-document", [])]
        if self.at(".") and not _IDENT.match(self.s, self.i + 1):
            self.i += 1
            return [Step("self", "node()", [])]
        if self.take("*"):
            name = "*"
        elif self.at("node()"):
            self.i += 6
            name = "node()"
        elif self.at("text()"):
            self.i += 6
            name = "text()"
        elif m := self.match(_IDENT):
            name = m.group().lower()
        elif self.i >= len(self.s) or self.s[self.i] not in "#.[:":
            self.fail("a step expected")
        if axis == "adjacent":
            step_axis = "following-sibling"
            before.append(Step(step_axis, "*", [lambda d, n, i, k: i == 1]))
            axis = "self"
        after: list[Step] = []
        while self.i < len(self.s):
            if self.take("#"):
                tests.append(_attribute("id", "=", self.ident()))
            elif self.at(".") and _IDENT.match(self.s, self.i + 1):
                self.i += 1
                tests.append(_attribute("class", "~=", self.ident()))
            elif self.take("["):
                tests.append(self.predicate())
            elif self.at(":") and not self.at("::"):
                self.i += 1
                tests.append(self.pseudo())
            elif self.at("@"):
                self.i += 1
                after.append(Step("attribute", "*" if self.take("*") else self.ident().lower(), []))
                break
            else:
                break
        return [*before, Step(axis, name, tests, deep), *after]

    # -- pseudo classes

    def pseudo(self) -> Test:
        name = self.ident()
        if name not in PSEUDO:
            self.fail(f"unknown pseudo class {name!r}")
        inner: list[Path] = []
        arg = ""
        if self.take("("):
            self.space()
            if name in ("contains", "starts-with", "domain", "path", "nth-child"):
                if self.at('"') or self.at("'"):
                    arg = self.string()
                    self.need(")")
                else:
                    end = self.s.find(")", self.i)
                    if end < 0:
                        self.fail("')' expected")
                    arg, self.i = self.s[self.i : end].strip(), end + 1
            else:
                inner = self.union(")")
                self.need(")")
        return _pseudo(self, name, arg, inner)

    # -- bracket conditions

    def predicate(self) -> Test:
        self.space()
        css = None if self.raw else re.compile(r"([A-Za-z_][\w-]*)\s*(?:([~|^$*!]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]").match(self.s, self.i)
        if css:
            self.i = css.end()
            value = next((v for v in css.groups()[2:] if v is not None), None)
            return _attribute(css[1].lower(), css[2] or "", value)
        value = self.either()
        self.need("]")

        def test(doc: Document, node: int, i: int, size: int) -> bool:
            got = value(doc, node, i, size)
            return got == i if isinstance(got, (int, float)) and not isinstance(got, bool) else _truth(got)

        return test

    def either(self):
        terms = [self.both()]
        while self.word("or"):
            terms.append(self.both())
        return terms[0] if len(terms) == 1 else lambda *c: any(_truth(t(*c)) for t in terms)

    def both(self):
        terms = [self.compared()]
        while self.word("and"):
            terms.append(self.compared())
        return terms[0] if len(terms) == 1 else lambda *c: all(_truth(t(*c)) for t in terms)

    def word(self, text: str) -> bool:
        self.space()
        m = re.compile(rf"{text}(?![\w-])").match(self.s, self.i)
        if m:
            self.i = m.end()
        return bool(m)

    def compared(self):
        left = self.sum()
        self.space()
        for sign in ("!=", "<=", ">=", "=", "<", ">"):
            if self.take(sign):
                right = self.sum()
                return lambda *c, sign=sign: _compare(left(*c), sign, right(*c))
        return left

    def sum(self):
        left = self.primary()
        while True:
            self.space()
            m = re.compile(r"([+-])\s*(?=[\d(]|last|position|count)").match(self.s, self.i)
            if not m:
                return left
            self.i = m.end()
            right, one = self.primary(), left
            left = (lambda *c, a=one, b=right: _number(a(*c)) + _number(b(*c))) if m[1] == "+" else (lambda *c, a=one, b=right: _number(a(*c)) - _number(b(*c)))

    def primary(self):
        self.space()
        if self.take("("):
            value = self.either()
            self.need(")")
            return value
        if self.at('"') or self.at("'"):
            text = self.string()
            return lambda *c: text
        if m := self.match(_NUMBER):
            number = float(m.group())
            return lambda *c: number
        m = re.compile(r"([a-z-]+)\(").match(self.s, self.i)
        if m and m[1] not in ("node", "text"):
            if m[1] not in _FUNCTIONS:
                self.fail(f"unknown function {m[1]!r}")
            self.i = m.end()
            args = []
            self.space()
            while not self.take(")"):
                args.append(self.either())
                self.space()
                self.take(",")
                self.space()
                if self.i >= len(self.s):
                    self.fail("')' expected")
            function = _FUNCTIONS[m[1]]
            return lambda doc, node, i, size: function(doc, node, i, size, *[a(doc, node, i, size) for a in args])
        outer_raw, self.raw = self.raw, True
        path = self.path(relative=True)
        self.raw = outer_raw
        return lambda doc, node, i, size: [content(doc, r) for r in path.run(doc, node)]


def content(doc: Document, ref: Ref) -> str:
    node, attr = ref
    return doc.text(node) if attr is None else doc.attrs[node].get(attr, "")


def _truth(value) -> bool:
    return len(value) > 0 if isinstance(value, (list, str)) else bool(value)


def _number(value) -> float:
    try:
        return float(value[0] if isinstance(value, list) else value)
    except (ValueError, IndexError, TypeError):
        return float("nan")


def _compare(a, sign: str, b) -> bool:
    left, right = (x if isinstance(x, list) else [x] for x in (a, b))
    for x in left:
        for y in right:
            if sign in ("=", "!="):
                same = _number(x) == _number(y) if isinstance(x, (int, float)) or isinstance(y, (int, float)) else x == y
                if same == (sign == "="):
                    return True
            else:
                p, q = _number(x), _number(y)
                if (sign == "<" and p < q) or (sign == ">" and p > q) or (sign == "<=" and p <= q) or (sign == ">=" and p >= q):
                    return True
    return False


def _string(doc: Document, node: int, args: tuple) -> str:
    if not args:
        return doc.text(node)
    value = args[0]
    if isinstance(value, list):
        return value[0] if value else ""
    return f"{value:g}" if isinstance(value, float) else str(value)


_FUNCTIONS = {
    "last": lambda d, n, i, k: k,
    "position": lambda d, n, i, k: i,
    "count": lambda d, n, i, k, x: len(x),
    "not": lambda d, n, i, k, x: not _truth(x),
    "contains": lambda d, n, i, k, x, y: _string(d, n, (y,)) in _string(d, n, (x,)),
    "starts-with": lambda d, n, i, k, x, y: _string(d, n, (x,)).startswith(_string(d, n, (y,))),
    "string": lambda d, n, i, k, *x: _string(d, n, x),
    "string-length": lambda d, n, i, k, *x: len(_string(d, n, x)),
    "normalize-space": lambda d, n, i, k, *x: " ".join(_string(d, n, x).split()),
    "name": lambda d, n, i, k: d.name[n],
    "true": lambda d, n, i, k: True,
    "false": lambda d, n, i, k: False,
}


def _attribute(name: str, sign: str, value: str | None) -> Test:
    def test(doc: Document, node: int, i: int, size: int) -> bool:
        got = doc.attrs[node].get(name)
        if sign == "!=":
            return got != value
        if got is None:
            return False
        if not sign:
            return True
        if sign == "=":
            return got == value
        if sign == "~=":
            return value in got.split()
        if sign == "|=":
            return got == value or got.startswith(value + "-")
        return {"^=": got.startswith, "$=": got.endswith, "*=": got.__contains__}[sign](value) if value else False

    return test


def link_of(doc: Document, node: int) -> str | None:
    """Where a link, a form or an embedding element points to, resolved."""
    attrs = doc.attrs[node]
    raw = next((attrs[a] for a in ("href", "src", "action") if a in attrs), None)
    return None if raw is None else urljoin(doc.url or "", raw)


def _host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _pseudo(parser: _Parser, name: str, arg: str, inner: list[Path]) -> Test:
    def beside(doc: Document, node: int) -> list[int]:
        return [c for c in doc.children[doc.parent[node]] if doc.kind[c] == ELEMENT] if doc.parent[node] >= 0 else [node]

    def inside(doc: Document, node: int) -> bool:
        return any(p.run(doc, node) for p in inner)

    def is_one(doc: Document, node: int) -> bool:
        for p in inner:
            if len(p.steps) == 1 and p.steps[0].axis == "child":
                if p.steps[0].matches(doc, node):
                    return True
            elif any(r == (node, None) for r in p.run(doc, 0)) or p.steps[0].axis == "attribute" and p.run(doc, node):
                return True
        return False

    def elsewhere(doc: Document) -> list[int]:
        return [r[0] for p in inner for r in p.run(doc, 0)]

    def has_link(doc: Document, node: int, want: Callable[[str], bool]) -> bool:
        link = link_of(doc, node)
        return link is not None and want(link)

    def nth(at: int) -> bool:
        text = arg.replace(" ", "")
        if text in ("odd", "even"):
            return at % 2 == (text == "odd")
        m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", text)
        if m:
            a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
            rest = at - int(m[2] or 0)
            return rest == 0 if a == 0 else rest % a == 0 and rest // a >= 0
        return at == int(text)

    if name in ("not", "has", "before", "after") and not inner or name in ("contains", "starts-with", "domain", "path", "nth-child") and not arg:
        parser.fail(f":{name} needs an argument")
    return {
        "first": lambda d, n, i, k: i == 1,
        "last": lambda d, n, i, k: i == k,
        "skip-last": lambda d, n, i, k: i < k,
        "odd": lambda d, n, i, k: i % 2 == 1,
        "even": lambda d, n, i, k: i % 2 == 0,
        "first-child": lambda d, n, i, k: beside(d, n)[:1] == [n],
        "last-child": lambda d, n, i, k: beside(d, n)[-1:] == [n],
        "only-child": lambda d, n, i, k: beside(d, n) == [n],
        "nth-child": lambda d, n, i, k: n in beside(d, n) and nth(beside(d, n).index(n) + 1),
        "empty": lambda d, n, i, k: not d.children[n],
        "contains": lambda d, n, i, k: arg in d.text(n),
        "starts-with": lambda d, n, i, k: d.text(n).strip().startswith(arg),
        "has": lambda d, n, i, k: inside(d, n),
        "not": lambda d, n, i, k: not is_one(d, n),
        "before": lambda d, n, i, k: any(m > d.last[n] for m in elsewhere(d)),
        "after": lambda d, n, i, k: any(n > d.last[m] for m in elsewhere(d)),
        "internal": lambda d, n, i, k: has_link(d, n, lambda u: _host(u) == _host(d.url or "")),
        "external": lambda d, n, i, k: has_link(d, n, lambda u: _host(u) != _host(d.url or "")),
        "domain": lambda d, n, i, k: has_link(d, n, lambda u: _host(u) == arg.removeprefix("www.")),
        "path": lambda d, n, i, k: has_link(d, n, lambda u: urlsplit(u).path.startswith(arg)),
        "checked": lambda d, n, i, k: "checked" in d.attrs[n],
        "selected": lambda d, n, i, k: "selected" in d.attrs[n],
        "disabled": lambda d, n, i, k: "disabled" in d.attrs[n],
        "enabled": lambda d, n, i, k: d.kind[n] != DOCUMENT and "disabled" not in d.attrs[n],
    }[name]


def is_xpath(source: str) -> bool:
    """A selector that begins like an XPath is one throughout."""
    s = source.strip()
    return s[:1] in ("/", "(") or s[1:2] == "/"


@lru_cache(maxsize=4096)
def compile_selector(source: str) -> Selector:
    raw = is_xpath(source)
    s = source.strip()
    if raw and s.startswith("(") and s.endswith(")"):
        s = s[1:-1]
    if not s:
        raise SelectorError("an empty selector")
    return Selector(source, _Parser(s, raw).union())
