"""Documents and selectors."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webweft.dom.markup import tokens
from webweft.dom.selector import SelectorError, compile_selector, content
from webweft.dom.tree import Document

LISTS = (
    '<body><div class="content"><ul name="test"><li>x <b>1</b></li></ul><ul><li><b>2</b></li>'
    '<li><b>3</b> <b><img src=1><img src=2><img src=3></b></li></ul></div></body>'
)


def names(html, selector, url="http://localhost/x"):
    doc = Document(html, url)
    return [content(doc, r).strip() if r[1] else doc.name[r[0]] for r in compile_selector(selector).find(doc)]


@pytest.mark.parametrize(
    ("selector", "count"),
    [("img", 3), ("b", 4), ("img, b", 7), ("ul:not([name]) li[2] img@src", 3), ("b:last img", 3), ("//div[@class]/ul[2]/li", 2), (".content//preceding::[@name]", 1), ("ul li", 3), ("ul > b", 0),
     ("li:skip-last", 1), ("ul:has(img)", 1), ("li:contains('2')", 1), ("ul + ul", 1), ("node():not(:contains('x'))", 14), ("ul[name^='te']", 1), ("ul[@name='test' or count(li) = 2]", 2), (".//b", 4)],
)
def test_finds(selector, count):
    assert len(names(LISTS, selector)) == count


def test_attributes_come_in_order():
    assert names(LISTS, "img@src") == ["1", "2", "3"]
    assert names('<a href="/1">x</a><a href="/2">y</a>', "a:first@href") == ["/1"]


def test_link_predicates():
    html = '<a href="?p=1">a</a><a href="http://www.localhost/y">b</a><a href="http://other.org/z">c</a>'
    assert len(names(html, "a:internal")) == 2
    assert len(names(html, "a:external")) == 1
    assert len(names(html, "a:domain(other.org)")) == 1
    assert len(names(html, "a:path('/z')")) == 1


@pytest.mark.parametrize("selector", ["a:unknown", "a[", "a >", "!!", "", "a:not()", "foo::bar"])
def test_unknown_syntax_is_refused(selector):
    with pytest.raises(SelectorError):
        compile_selector(selector)


def test_repair():
    assert names("<p>a<p>b<ul><li>1<li>2</ul>", "p, li") == ["p", "p", "li", "li"]
    doc = Document("<table><tr><td>a<td>b<tr><td>c</table>")
    assert len(compile_selector("tr").find(doc)) == 2
    assert Document("").text(0) == ""
    assert Document("<title>x</title>").outer(0) == "<html><head><title>x</title></head></html>"


def test_script_text_is_no_markup():
    assert [t[1] for t in tokens('<script>var t="</p>";</script>&amp x &am') if t[0] == 3] == ['var t="</p>";', "& x &am"]


def test_serialized():
    doc = Document('<p class="a&quot;b">1 &lt; 2<br>x</p>')
    p = compile_selector("p").first(doc)[0]
    assert doc.outer(p) == '<p class="a&quot;b">1 &lt; 2<br>x</p>'
    assert doc.inner(p) == "1 &lt; 2<br>x"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='<>/="abp !-&;\' ', max_size=60))
def test_any_text_parses_and_ids_are_in_document_order(html):
    doc = Document(html)
    for i in range(1, len(doc.kind)):
        assert doc.parent[i] < i <= doc.last[i] <= doc.last[doc.parent[i]]
    Document(doc.outer(0))
