"""Requests that HTML forms make when they are submitted."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urljoin

from ..dom.selector import compile_selector
from ..dom.tree import ELEMENT, Document

URLENCODED = "application/x-www-form-urlencoded"


@dataclass
class FormRequest:
    method: str
    url: str
    enctype: str
    params: dict[str, list[str]] = field(default_factory=dict)

    @property
    def multipart(self) -> bool:
        return self.enctype.startswith("multi")


def _type(doc: Document, node: int) -> str:
    return doc.attrs[node].get("type", "").lower()


def _is_submit(doc: Document, node: int) -> bool:
    return doc.name[node] in ("button", "input") and (_type(doc, node) == "submit" or doc.name[node] == "button" and not _type(doc, node))


def form_of(doc: Document, node: int) -> int | None:
    """The form that an element is or belongs to: by its ``form`` attribute, else around it."""
    if doc.name[node] == "form":
        return node
    if owner := doc.attrs[node].get("form"):
        return next((i for i in range(len(doc.kind)) if doc.name[i] == "form" and doc.attrs[i].get("id") == owner), None)
    return next((i for i in doc.ancestors(node) if doc.name[i] == "form"), None)


def _controls(doc: Document, form: int) -> list[int]:
    """Enabled named controls of a form in order, those elsewhere that name it included."""
    own = doc.attrs[form].get("id")
    inside = range(form + 1, doc.last[form] + 1)
    found = []
    for i in range(len(doc.kind)):
        if doc.kind[i] == ELEMENT and "name" in doc.attrs[i] and "disabled" not in doc.attrs[i]:
            owner = doc.attrs[i].get("form")
            if (owner == own if owner else i in inside) and not _is_submit(doc, i):
                found.append(i)
    return found


def _submit_button(doc: Document, form: int) -> int | None:
    own = doc.attrs[form].get("id")
    for i in range(len(doc.kind)):
        if doc.kind[i] == ELEMENT and doc.name[i] in ("button", "input") and _type(doc, i) == "submit" and "disabled" not in doc.attrs[i]:
            owner = doc.attrs[i].get("form")
            if owner == own if owner else form < i <= doc.last[form]:
                return i
    return None


def _values(doc: Document, node: int) -> list[tuple[str, str]]:
    """Names and values that one control adds."""
    attrs, tag, kind = doc.attrs[node], doc.name[node], _type(doc, node)
    name = attrs["name"]
    if name.endswith("]"):
        name = name[:-2]
    if tag == "select":
        options = [i for i in range(node + 1, doc.last[node] + 1) if doc.name[i] == "option"]
        chosen = [i for i in options if "selected" in doc.attrs[i]] or options[:1]
        if "multiple" not in attrs:
            chosen = chosen[:1]
        return [(name, doc.attrs[i].get("value", doc.text(i).strip())) for i in chosen]
    if tag == "textarea":
        return [(name, doc.text(node))]
    if tag not in ("input", "button"):
        return []
    out = []
    if kind in ("radio", "image"):
        out = [(f"{name}.x", "0"), (f"{name}.y", "0")]
    if kind in ("checkbox", "radio", "image"):
        return out + ([(name, attrs.get("value", "on"))] if "checked" in attrs else [])
    return [(name, attrs.get("value", ""))]


def form_request(doc: Document, node: int, overrides: dict | None = None) -> FormRequest | None:
    """The request of a form, or of the form that a submit button belongs to; None without a form.

    The button's own attributes win over the form's. Several values of a name stay in order;
    ``overrides`` replace a name's values.
    """
    form = form_of(doc, node)
    if form is None:
        return None
    button = node if node != form and _is_submit(doc, node) else _submit_button(doc, form)
    pressed = doc.attrs[button] if button is not None else {}
    attrs = doc.attrs[form]

    def attr(name: str) -> str | None:
        """The button that was asked for speaks first, else the form, else its own button."""
        if node == button and f"form{name}" in pressed:
            return pressed[f"form{name}"]
        return attrs.get(name) or pressed.get(f"form{name}")

    out = FormRequest((attr("method") or "get").lower(), urljoin(doc.url or "", attr("action") or doc.url or ""), attr("enctype") or URLENCODED)
    for control in _controls(doc, form):
        for name, value in _values(doc, control):
            out.params.setdefault(name, []).append(value)
    if button is not None and "name" in pressed:
        out.params.setdefault(pressed["name"], []).append(pressed.get("value", "Submit Query"))
    for name, value in (overrides or {}).items():
        out.params[name] = [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]
    return out


def login_request(doc: Document, node: int, user: str, password: str) -> FormRequest | None:
    """The first form with a password field, filled: the user's name goes into the last text
    field before the password."""
    form = compile_selector('form:has(input[type="password"])').first(doc, node)
    if form is None:
        return None
    inputs = [i for i in range(form[0], doc.last[form[0]] + 1) if doc.name[i] == "input" and "name" in doc.attrs[i]]
    secret = next((i for i in inputs if _type(doc, i) == "password"), None)
    if secret is None:
        return None
    texts = [i for i in inputs if i < secret and _type(doc, i) in ("", "text", "email")]
    fill = {doc.attrs[secret]["name"]: password}
    if texts:
        fill[doc.attrs[texts[-1]]["name"]] = user
    return form_request(doc, form[0], fill)
