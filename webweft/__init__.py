"""webweft: extraction of structured data from web documents, as Spark plans."""

from .plans.chain import Chain, starter
from .plans.spec import INDEX, LAST, Fn, Node
from .sources.pages import HttpFetcher, Snapshot

over = starter("over")
parse = starter("parse")
get = starter("get")
post = starter("post")
follow = starter("follow")
submit = starter("submit")
login = starter("login")
paginate = starter("paginate")
find = starter("find")
select = starter("select")
set = starter("set")  # noqa: A001
do = starter("do")
filter = starter("filter")  # noqa: A001
success = starter("success")
fail = starter("fail")
contains = starter("contains")
match = starter("match")
then = starter("then")
config = starter("config")

__all__ = [
    "INDEX", "LAST", "Chain", "Fn", "HttpFetcher", "Node", "Snapshot", "config", "contains", "do", "fail", "filter", "find", "follow",
    "get", "login", "match", "over", "paginate", "parse", "post", "select", "set", "starter", "submit", "success", "then",
]
