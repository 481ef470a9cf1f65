"""Documents as arrays of nodes in document order, and what can be read off a node."""

from __future__ import annotations

from functools import lru_cache
from html import escape

from .markup import END, RAW, START, VOID, decoded, tokens

DOCUMENT, ELEMENT, TEXT_NODE = 0, 1, 2

#: A start tag of a key ends open elements of its values, up to the fence that holds them.
_IMPLIED = {
    **dict.fromkeys(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(),
        (("p",), ("button", "td", "th", "object", "caption")),
    ),
    "li": (("li", "p"), ("ul", "ol", "menu")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
_HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: An end tag doesn't reach beyond these.
_FENCES = frozenset("table td th body html".split())


class Document:
    """A parsed document. Node 0 is the document; ids rise in document order (pre-order), so the
    same text always gives the same ids. ``last[i]`` is the last node inside node i."""

    __slots__ = ("url", "kind", "name", "attrs", "value", "parent", "children", "last", "root")

    def __init__(self, html: str, url: str | None = None):
        self.url = url
        self.kind, self.name, self.attrs, self.value = [DOCUMENT], ["#document"], [{}], [""]
        self.parent, self.children, self.last = [-1], [[]], [0]
        self._build(html or "")
        for i in range(len(self.kind) - 1, -1, -1):
            self.last[i] = self.last[self.children[i][-1]] if self.children[i] else i
        self.root = next((i for i in self.children[0] if self.kind[i] == ELEMENT), None)

    def _add(self, parent: int, kind: int, name: str, attrs: dict[str, str], value: str = "") -> int:
        i = len(self.kind)
        for column, item in ((self.kind, kind), (self.name, name), (self.attrs, attrs), (self.value, value), (self.parent, parent), (self.children, []), (self.last, i)):
            column.append(item)
        self.children[parent].append(i)
        return i

    def _build(self, html: str) -> None:
        stack = [0]
        head_done = False

        def into_body(tag: str | None) -> None:
            """Make sure that there is an element for content to stand in, as a browser does."""
            nonlocal head_done
            if len(stack) == 1:
                stack.append(self._add(0, ELEMENT, "html", {}) if self.root_element() is None else self.root_element())
            if len(stack) == 2 and self.name[stack[1]] == "html":
                if tag in _HEAD_ONLY and not head_done:
                    stack.append(self._add(stack[1], ELEMENT, "head", {}))
                else:
                    head_done = True
                    stack.append(self._add(stack[1], ELEMENT, "body", {}))
            elif len(stack) == 3 and self.name[stack[2]] == "head" and tag not in _HEAD_ONLY:
                stack.pop()
                head_done = True
                stack.append(self._add(stack[1], ELEMENT, "body", {}))

        for kind, value, attrs in tokens(html, decoded):
            if kind == START:
                if value in ("html", "head", "body"):
                    known = next((i for i in range(1, len(self.kind)) if self.name[i] == value and self.kind[i] == ELEMENT), None)
                    if known is not None:
                        for k, v in attrs.items():
                            self.attrs[known].setdefault(k, v)
                        continue
                    if value != "html" and len(stack) == 1:
                        stack.append(self._add(0, ELEMENT, "html", {}))
                    if value == "body":
                        head_done = True
                        del stack[2:]
                    stack.append(self._add(stack[-1], ELEMENT, value, dict(attrs)))
                    continue
                into_body(value)
                if value in _IMPLIED:
                    closed, fence = _IMPLIED[value]
                    at = len(stack) - 1
                    while at > 1 and self.name[stack[at]] not in fence:
                        if self.name[stack[at]] in closed:
                            del stack[at:]
                        at -= 1
                node = self._add(stack[-1], ELEMENT, value, dict(attrs))
                if value not in VOID:
                    stack.append(node)
            elif kind == END:
                for at in range(len(stack) - 1, 0, -1):
                    if self.name[stack[at]] == value:
                        if value not in ("html", "body"):
                            del stack[at:]
                        head_done = head_done or value == "head"
                        break
                    if self.name[stack[at]] in _FENCES:
                        break
            else:
                if not value.strip() and len(stack) < 3:
                    continue
                if self.name[stack[-1]] == "head" and not value.strip():
                    continue
                into_body(None) if value.strip() and self.name[stack[-1]] in ("#document", "html", "head") else None
                self._add(stack[-1], TEXT_NODE, "#text", {}, value)

    def root_element(self) -> int | None:
        return next((i for i in self.children[0] if self.kind[i] == ELEMENT), None)

    # ------------------------------------------------------------------ content

    def text(self, node: int) -> str:
        if self.kind[node] == TEXT_NODE:
            return self.value[node]
        return "".join([self.value[i] for i in range(node, self.last[node] + 1) if self.kind[i] == TEXT_NODE])

    def inner(self, node: int) -> str:
        return "".join([self.outer(c) for c in self.children[node]])

    def outer(self, node: int) -> str:
        if self.kind[node] == TEXT_NODE:
            raw = self.parent[node] > 0 and self.name[self.parent[node]] in RAW
            return self.value[node] if raw else escape(self.value[node], quote=False)
        if self.kind[node] == DOCUMENT:
            return self.inner(node)
        name = self.name[node]
        attrs = "".join([f' {k}="{escape(v)}"' for k, v in self.attrs[node].items()])
        return f"<{name}{attrs}>" if name in VOID else f"<{name}{attrs}>{self.inner(node)}</{name}>"

    def ancestors(self, node: int) -> list[int]:
        out = []
        while (node := self.parent[node]) > 0:
            out.append(node)
        return out


@lru_cache(maxsize=32)
def parsed(html: str, url: str | None) -> Document:
    """Parse, or take one of the documents that this worker has parsed last."""
    return Document(html, url)
