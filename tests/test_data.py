"""The data algebra, URL rules and forms."""

from webweft.dom.selector import compile_selector
from webweft.dom.tree import Document
from webweft.functions import urls
from webweft.operators.data import Data, merge_all
from webweft.operators.forms import form_request, login_request


def test_set_makes_arrays():
    assert Data().set("a", 1).set("a", 2).set("a", 3).value == {"a": [1, 2, 3]}
    assert Data([1]).set("k", 2).value == [1, 2]
    assert Data({"a": 1}).set("b", None).value == {"a": 1}


def test_push_and_merge():
    assert Data({"a": 1}).push(2).value == [{"a": 1}, 2]
    assert Data().push(None).value == []
    assert Data({"a": 1}).merge(Data({"a": 2, "b": 3})).value == {"a": [1, 2], "b": 3}
    assert Data({"a": 1}).merge(Data({"x": 1}, "k")).value == {"a": 1, "k": {"x": 1}}
    assert Data([1]).merge(Data([2, 3])).value == [1, [2, 3]]
    assert Data({}).merge(Data("scalar")).value == {}
    assert Data({}).merge(Data()).value == {}


def test_clones_share_nothing():
    a = Data({"x": [1]})
    b = a.clone().set("x", 2)
    assert (a.value, b.value) == ({"x": [1]}, {"x": [1, 2]})
    assert Data().is_empty() and Data({}).is_empty() and not Data([]).is_empty()
    assert merge_all([]) is None and merge_all([1]) == 1 and merge_all([1, None, 2]) == [1, 2]


def test_urls():
    assert urls.resolve(None, "//x/y") == "http://x/y"
    assert urls.resolve(None, "x.org") == "http://x.org"
    assert urls.resolve("http://h/a/b", "../c?d=1") == "http://h/c?d=1"
    assert urls.with_params("http://h/?a=1&b=2", {"a": 3}) == "http://h/?b=2&a=3"
    assert urls.params_of("http://h/?a=1&a=2&c=") == {"a": ["1", "2"], "c": [""]}


FORMS = """<form id="f" action="/go?x=1" method="POST">
<input name="t" value="v"><input name="d" disabled value="no"><input type="checkbox" name="c[]" checked>
<input type="checkbox" name="c[]" value="2" checked><input type="checkbox" name="u"><select name="s"><option value="1">a<option selected>b</select>
<select name="s2"><option>first<option>second</select><textarea name="ta">long</textarea><input type="submit" name="go"></form>
<input form="f" name="outer" value="o"><button type="submit" form="f" formmethod="get" formaction="/other" formenctype="multipart/form-data" name="b" value="B">x</button>
<form id="l"><input name="email"><input type="text" name="user"><input type="password" name="pass"></form>"""


def test_form_matrix():
    doc = Document(FORMS, "http://h/p")
    made = form_request(doc, compile_selector("form").first(doc)[0])
    assert (made.method, made.url, made.multipart) == ("post", "http://h/go?x=1", False)
    assert made.params == {"t": ["v"], "c": ["on", "2"], "s": ["b"], "s2": ["first"], "ta": ["long"], "outer": ["o"], "go": ["Submit Query"]}


def test_button_speaks_first():
    doc = Document(FORMS, "http://h/p")
    made = form_request(doc, compile_selector("button").first(doc)[0], {"t": "new"})
    assert (made.method, made.url, made.multipart) == ("get", "http://h/other", True)
    assert made.params["t"] == ["new"] and made.params["b"] == ["B"]


def test_login_fills_the_field_before_the_password():
    doc = Document(FORMS, "http://h/p")
    made = login_request(doc, 0, "me", "pw")
    assert made.params == {"email": [""], "user": ["me"], "pass": ["pw"]}
    assert login_request(Document("<form></form>"), 0, "a", "b") is None
