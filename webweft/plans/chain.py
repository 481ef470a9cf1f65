"""Chains of operators over web documents, and the Spark plans they stand for.

A chain is an immutable list of operators; each method returns a longer one. Compiling cuts it
at the operators that load other documents. All operators between two cuts run in one
Arrow-batched function that parses a document once; loading is an equi-join with a store of
pages; and a nested chain that leaves its document becomes a plan of its own over its parents'
rows, whose results are gathered by parent, in order, and joined back.
"""

from __future__ import annotations

import json
import tempfile
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal, InvalidOperation
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dom.selector import compile_selector, link_of
from ..dom.tree import parsed
from ..functions import urls
from ..operators import sinks
from ..operators.forms import form_request, login_request
from ..sources.pages import Snapshot, literal
from . import steps as S
from .spec import Fn, Node, evaluate, has_remote, is_chain, shape, type_of

#: Pages that an unlimited pagination loads at most, unless told otherwise.
MOST_PAGES = 100
#: Bytes of a table of pages from which on it is worth more than one task, and that one task is to parse.
SMALL_BYTES, TASK_BYTES = 1 << 20, 32 << 20

_PARAMS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
_REQUEST = T.StructType().add("i", "integer").add("method", "string").add("url", "string").add("params", _PARAMS).add("error", "string")
_BASE = ["_src", "_ord", "_url", "_html", "_node", "_attr", "_rparams", "_count"]


@dataclass(frozen=True)
class Chain:
    steps: tuple[S.Step, ...] = ()
    pages: DataFrame | None = None
    key: str | None = None
    keeps_partial: bool = False

    # ---------------------------------------------------------------- building

    def _with(self, *more: S.Step) -> Chain:
        return replace(self, steps=(*self.steps, *more))

    def over(self, pages: DataFrame, key: str | None = "page_id") -> Chain:
        """Start from every row of a table with ``url`` and ``html``; its other columns are kept.
        ``key`` must tell its rows apart; None takes the URL."""
        return replace(self, pages=pages, key=key)

    def parse(self, spark: SparkSession, html: str, base_url: str | None = None) -> Chain:
        return self.over(literal(spark, html, base_url))

    def get(self, target: str | Column | Callable, params: dict | Callable | None = None) -> Chain:
        return self._with(S.Request("get", target, params))

    def post(self, target: str | Column | Callable, params: dict | Callable | None = None) -> Chain:
        return self._with(S.Request("post", target, params))

    def follow(self, source: str) -> Chain:
        compile_selector(source)
        return self._with(S.Request("follow", source))

    def submit(self, source: str, params: dict | Callable | None = None) -> Chain:
        compile_selector(source)
        return self._with(S.Request("submit", source, params))

    def login(self, user: str, password: str) -> Chain:
        return self._with(S.Request("login", (user, password)))

    def paginate(self, target: str | dict | Callable, limit: int | str | Callable | None = None, max_pages: int = MOST_PAGES) -> Chain:
        """Go on with the current page, then with the next ones. A number as ``limit`` is
        that of pages after the first; a selector's digits, or a function of the node, give one too."""
        if isinstance(target, str):
            compile_selector(target)
        return self._with(S.Request("paginate", target, None, limit, {"max_pages": max_pages}))

    def find(self, source: str | list[str] | Callable) -> Chain:
        return self._with(S.Find(source if isinstance(source, str) or callable(source) else tuple(source)))

    def select(self, source: str | list[str] | Callable) -> Chain:
        return self._with(S.Find(source if isinstance(source, str) or callable(source) else tuple(source), relative=True))

    def set(self, fields: str | dict | list, spec: Any = None) -> Chain:
        if isinstance(fields, str):
            fields = {fields: spec}
        if isinstance(fields, (list, tuple)):
            return self._with(S.SetArray(tuple(fields)))
        for k, v in fields.items():
            if isinstance(v, (dict, list)) and not v:
                raise ValueError(f"the field {k!r} has an empty specification")
        return self._with(S.Set(dict(fields)))

    def do(self, *chains: Chain) -> Chain:
        return self._with(S.Do(tuple(chains)))

    def filter(self, source: str) -> Chain:
        return self._with(S.Keep(source, "filter"))

    def success(self, source: str) -> Chain:
        return self._with(S.Keep(source, "success"))

    def fail(self, source: str) -> Chain:
        return self._with(S.Keep(source, "fail"))

    def contains(self, text: str) -> Chain:
        return self._with(S.Contains(text))

    def match(self, pattern: str) -> Chain:
        return self._with(S.Match(pattern))

    def then(self, call: Callable, fields: dict[str, T.DataType] | None = None, on_document: bool = False) -> Chain:
        """Apply a function of (node, data); ``fields`` types what it sets in data."""
        return self._with(S.Then(call, dict(fields or {}), on_document))

    def partial(self) -> Chain:
        """As a nested chain within one document: rows that an operator drops still leave what
        they have gathered, or their text if that is nothing."""
        return replace(self, keeps_partial=True)

    def process_response(self, change: Callable[[Column], Column]) -> Chain:
        """Change the markup of the documents that the operators before have loaded, as a column.
        Where it becomes null the document is rejected, and :meth:`errors` says so; null markup
        that was null before stays without a word."""
        return self._with(S.Note("process_response", change))

    def config(self, name: str | dict, value: Any = None) -> Chain:
        options = name if isinstance(name, dict) else {name: value}
        return self._with(S.Note("config", options))

    def header(self, name: str, value: str) -> Chain:
        return self.config("headers", {name: value})

    def headers(self, values: dict[str, str]) -> Chain:
        return self.config("headers", dict(values))

    def cookie(self, name: str, value: str | None) -> Chain:
        return self.config("cookies", {name: value})

    def proxy(self, proxies: str | list[str]) -> Chain:
        return self.config("proxies", [proxies] if isinstance(proxies, str) else list(proxies))

    def delay(self, seconds: float) -> Chain:
        return self._with(S.Note("delay", seconds))

    def log(self, name: str = "log") -> Chain:
        """Count the rows that pass here; :attr:`observed` has the counts after an action."""
        return self._with(S.Note("log", Observation(name)))

    @property
    def observed(self) -> dict[str, Observation]:
        return {s.value._name: s.value for s in self.steps if isinstance(s, S.Note) and s.kind == "log"}

    def data(self, call: Callable[[dict], None], store: Any = None, spark: SparkSession | None = None) -> None:
        """Run the chain and call a function with each row's data, on the executors."""
        sinks.data(self.to_df(store, spark), call)

    def done(self, path: str, call: Callable[[], None], store: Any = None, spark: SparkSession | None = None) -> None:
        """Run the chain, write its rows as Parquet and then call a function once."""
        sinks.done(self.to_df(store, spark), path, call)

    def rewrite(self, *_: Any) -> Chain:
        warnings.warn("rewrite() does nothing; use find(selector).get(function)", DeprecationWarning, stacklevel=2)
        return self

    def click(self, *_: Any) -> Chain:
        raise NotImplementedError("click() needs a script engine; use then() with a function of your own")

    def trigger(self, *_: Any) -> Chain:
        raise NotImplementedError("trigger() needs a script engine; use then() with a function of your own")

    # -------------------------------------------------------------- properties

    @property
    def options(self) -> dict:
        """Options in force at the end: later ones win, maps are merged, None deletes."""
        out: dict = {}
        for s in self.steps:
            if isinstance(s, S.Note) and s.kind == "config":
                for k, v in s.value.items():
                    out[k] = {n: x for n, x in {**out.get(k, {}), **v}.items() if x is not None} if isinstance(v, dict) else v
            elif isinstance(s, S.Note) and s.kind == "delay":
                out["delay"] = s.value
        return out

    @property
    def leaves_document(self) -> bool:
        return any(not s.local or isinstance(s, S.Set) and has_remote(s.fields) or isinstance(s, S.Do) and any(c.leaves_document for c in s.chains) for s in self.steps)

    @property
    def fields(self) -> dict:
        """What the chain sets, by name, as specifications (types for functions' fields)."""
        out: dict = {}
        for s in self.steps:
            if isinstance(s, S.Set):
                out.update(s.fields)
            elif isinstance(s, S.SetArray):
                out["value"] = list(s.items)
            elif isinstance(s, S.Then):
                out.update({k: Fn(None, t) for k, t in s.fields.items()})
            elif isinstance(s, S.Do):
                for c in s.chains:
                    out.update(c.fields)
        return out

    @property
    def merged_many(self) -> bool:
        """Whether a chain may give several rows for a context."""
        return any(isinstance(s, (S.Find, S.Then)) or isinstance(s, S.Request) and s.kind in ("follow", "paginate") for s in self.steps)

    @property
    def data_type(self) -> T.StructType:
        return _data_type(self.steps)

    @property
    def result_type(self) -> T.DataType:
        kind = self.data_type
        return kind if kind.fields else T.StringType()

    def local_values(self, node: Node) -> list:
        """Results of a nested chain that stays in its document."""
        rows = S.run_local(self.steps, S.Row(node, {}), True, [], partial=self.keeps_partial)
        if not self.data_type.fields:
            return [r.node.text() for r in rows]
        return [r.data for r in rows if any(v is not None and v != [] for v in r.data.values())]

    # --------------------------------------------------------------- compiling

    def to_df(self, store: Any = None, spark: SparkSession | None = None, with_request: bool = False) -> DataFrame:
        """The lazy plan: the start table's own columns and those that the chain sets.

        ``store`` answers requests: a Snapshot, or a DataFrame of pages. ``with_request`` adds
        ``request``, the URL, parameters and number of the page that a row comes from.
        """
        state = _compile(_started(self, store, spark), self.steps, _store(store, self.options), False)
        extra = [F.struct(F.col("_url").alias("url"), F.col("_rparams").alias("params"), F.col("_count").alias("count")).alias("request")] if with_request else []
        fields = [F.col("_data")[n].alias(n) for n in state.fields.fieldNames()]
        return state.df.select(*[f"`{c}`" for c in state.keep], *fields, *extra)

    def errors(self, store: Any = None, spark: SparkSession | None = None) -> DataFrame:
        """``_src, message``: what the chain could not find or load, as the log would have it."""
        found: list[DataFrame] = []
        _compile(_started(self, store, spark), self.steps, _store(store, self.options), False, found)
        out = found[0] if found else None
        for f in found[1:]:
            out = out.unionByName(f)
        if out is None:
            raise ValueError("an empty chain logs nothing")
        return out

    def to_json(self, store: Any = None, spark: SparkSession | None = None) -> DataFrame:
        """Like :meth:`to_df`, with the data as JSON in the loose shape: absent fields left
        out, and a nested chain's results as nothing, the one itself, or an array."""
        df = self.to_df(store, spark)
        fields, names = self.fields, self.data_type.fieldNames()
        array_root = any(isinstance(s, S.SetArray) for s in self.steps)

        @F.arrow_udf("string")
        def render(rows: pa.Array) -> pa.Array:
            found = ({k: v for k in names if (v := shape(row[k], fields[k])) is not None} for row in rows.to_pylist())
            return pa.array([json.dumps(out.get("value", []) if array_root else out, ensure_ascii=False) for out in found], pa.string())

        kept = [c for c in df.columns if c not in names]
        return df.select(*[f"`{c}`" for c in kept], render(F.struct(*[F.col(f"`{n}`") for n in names])).alias("data"))


def _data_type(steps: tuple[S.Step, ...]) -> T.StructType:
    found: dict[str, T.DataType] = {}

    def put(name: str, kind: T.DataType) -> None:
        if name in found and not isinstance(found[name], T.ArrayType):
            kind = T.ArrayType(found[name])
        elif name in found:
            kind = found[name]
        found[name] = kind

    for s in steps:
        if isinstance(s, S.Set):
            for k, v in s.fields.items():
                put(k, type_of(v))
        elif isinstance(s, S.SetArray):
            put("value", type_of(list(s.items)))
        elif isinstance(s, S.Then):
            for k, t in s.fields.items():
                put(k, t)
        elif isinstance(s, S.Do):
            for c in s.chains:
                for f in c.data_type.fields:
                    found[f.name] = T.ArrayType(f.dataType) if c.merged_many else f.dataType
    return T.StructType([T.StructField(k, t) for k, t in found.items()])


@dataclass
class _State:
    df: DataFrame
    keep: list[str]
    fields: T.StructType


def _store(store: Any, options: dict):
    """What answers requests, with the chain's options over its own settings."""
    store = Snapshot(store) if isinstance(store, DataFrame) else store
    return store.with_options(options) if hasattr(store, "with_options") else store


def scoped(store: Any, chain: Chain) -> Any:
    """The parent's store with a nested chain's own options over it, for that chain only."""
    return store.with_options(chain.options) if chain.options and hasattr(store, "with_options") else store


def _spread(pages: DataFrame) -> DataFrame:
    """A small table over all cores: a few megabytes of markup lie in one row group, and so would be
    parsed by one task. Tables with more than TASK_BYTES for each core stay as they are."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.isStreaming:
        return pages
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return pages.repartition(cores) if SMALL_BYTES <= size <= cores * TASK_BYTES else pages


def _started(chain: Chain, store: Any, spark: SparkSession | None) -> _State:
    if chain.pages is not None:
        pages, keep = _spread(chain.pages), [c for c in chain.pages.columns if c not in ("url", "html")]
        src = F.col(f"`{chain.key}`").cast("string") if chain.key else F.col("url")
        df = pages.select(*[f"`{c}`" for c in keep], src.alias("_src"), F.col("url").alias("_url"), F.col("html").alias("_html"))
    else:
        spark = spark or (store.pages if isinstance(store, Snapshot) else store).sparkSession
        keep = []
        df = spark.range(1).select(F.lit("0").alias("_src"), F.lit(None).cast("string").alias("_url"), F.lit(None).cast("string").alias("_html"))
    df = df.withColumns({"_ord": F.array().cast("array<int>"), "_node": F.lit(0), "_attr": F.lit(None).cast("string"), "_rparams": F.lit(None).cast(_PARAMS), "_count": F.lit(1)})
    return _State(df.withColumn("_data", F.lit(None).cast("struct<_:boolean>")), keep, T.StructType())


def _compile(state: _State, steps: tuple[S.Step, ...], store: Any, nested: bool, errors: list[DataFrame] | None = None) -> _State:
    run: list[S.Step] = []

    def flush() -> None:
        nonlocal state, run
        if run:
            state = _segment(state, tuple(run), nested, errors)
            run = []

    for s in steps:
        if not s.local:
            flush()
            state = _paginated(state, s, store, errors) if s.kind == "paginate" else _requested(state, s, store, errors)
        elif isinstance(s, S.Note):
            if s.kind == "process_response":
                flush()
                state = _processed(state, s.value, errors)
            elif s.kind == "log":
                flush()
                state.df = state.df.observe(s.value, F.count(F.lit(1)).alias("rows"))
        elif isinstance(s, S.Set) and has_remote(s.fields):
            run.append(S.Set({k: _lowered(v) for k, v in s.fields.items()}))
            flush()
            state = _joined_fields(state, s.fields, store)
        elif isinstance(s, S.Do) and any(c.leaves_document for c in s.chains):
            for c in s.chains:
                if c.leaves_document:
                    flush()
                    state = _joined_do(state, c, store)
                else:
                    run.append(S.Do((c,)))
        else:
            run.append(s)
    flush()
    return state


def _processed(state: _State, change: Callable[[Column], Column], errors: list[DataFrame] | None) -> _State:
    made = state.df.withColumn("_new", change(F.col("_html")))
    if errors is not None:
        errors.append(made.filter("_html is not null and _new is null").select("_src", F.lit("(process_response) rejected").alias("message")))
    return _State(made.filter("_html is null or _new is not null").drop("_html").withColumnRenamed("_new", "_html"), state.keep, state.fields)


# ------------------------------------------------------------------- local segments


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _segment(state: _State, steps: tuple[S.Step, ...], nested: bool, errors: list[DataFrame] | None) -> _State:
    """Run local operators over each row's document: one parse, one function, one explode."""
    made = _data_type(steps)
    data = made if made.fields else T.StructType().add("_", "boolean")
    row = T.StructType().add("ord", T.ArrayType(T.IntegerType())).add("node", "integer").add("attr", "string").add("data", data).add("text", "string")
    result = T.StructType().add("rows", T.ArrayType(row)).add("errors", T.ArrayType(T.StringType()))
    arrow, names, plain = _arrow(result), made.fieldNames(), not made.fields and not state.fields.fields
    reads = bool(state.fields.fields) and any(isinstance(s, S.Then) or callable(getattr(s, "source", None)) or isinstance(s, S.Set) and any(map(callable, s.fields.values())) or isinstance(s, S.Set) and any(isinstance(v, Fn) for v in s.fields.values()) for s in steps)

    @F.arrow_udf(result)
    def run(html: pa.Array, url: pa.Array, node: pa.Array, attr: pa.Array, before: pa.Array) -> pa.Array:
        out = []
        for h, u, n, a, b in zip(html.to_pylist(), url.to_pylist(), node.to_pylist(), attr.to_pylist(), before.to_pylist(), strict=True):
            rows, said = [], []
            if h is None or not h.strip():
                said.append("(parse) the document is empty")
            if h is not None:
                start = S.Row(Node(parsed(h, u), (n, a)), json.loads(b) if b else {})
                for r in S.run_local(steps, start, nested, said):
                    rows.append({"ord": list(r.order), "node": r.node.ref[0], "attr": r.node.ref[1], "data": {k: r.data.get(k) for k in names}, "text": r.node.text() if plain else None})
            out.append({"rows": rows, "errors": said})
        return pa.array(out, arrow)

    before = F.to_json("_data") if reads else F.lit(None).cast("string")
    ran = state.df.withColumn("_ran", run("_html", "_url", "_node", "_attr", before))
    if errors is not None:
        errors.append(ran.select("_src", F.explode("_ran.errors").alias("message")))
    keep = [f"`{c}`" for c in state.keep]
    # An outer generator: of an inner one the optimizer would infer a filter that runs the function twice.
    done = ran.select(*keep, "_src", "_url", "_html", "_rparams", "_count", "_ord", "_data", F.explode_outer("_ran.rows").alias("_r")).filter(F.col("_r").isNotNull())
    fields, merged = _merged(state.fields, made, F.col("_data"), F.col("_r.data"))
    df = done.select(*keep, "_src", F.concat("_ord", "_r.ord").alias("_ord"), "_url", "_html", F.col("_r.node").alias("_node"), F.col("_r.attr").alias("_attr"), "_rparams", "_count", merged.alias("_data"), *([F.col("_r.text").alias("_text")] if plain else []))
    return _State(df, state.keep, fields)


def _merged(old: T.StructType, new: T.StructType, a: Column, b: Column) -> tuple[T.StructType, Column]:
    """Fields set before and now; a name set again becomes an array of both."""
    out, columns = [], []
    for f in old.fields:
        if f.name not in new.fieldNames():
            out.append(f)
            columns.append(a[f.name].alias(f.name))
            continue
        g = new[f.name].dataType
        many = [x if isinstance(t, T.ArrayType) else F.array_compact(F.array(x)) for x, t in ((a[f.name], f.dataType), (b[f.name], g))]
        base = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        empty = F.array().cast(T.ArrayType(base))
        out.append(T.StructField(f.name, T.ArrayType(base)))
        columns.append(F.concat(*[F.coalesce(m, empty) for m in many]).alias(f.name))
    for f in new.fields:
        if f.name not in old.fieldNames():
            out.append(f)
            columns.append(b[f.name].alias(f.name))
    return T.StructType(out), F.struct(*columns) if columns else F.lit(None).cast("struct<_:boolean>")


# ------------------------------------------------------------ nested chains across documents


def _lowered(spec: Any) -> Any:
    """A specification without the chains that leave the document; their places stay."""
    if is_chain(spec):
        return Fn(lambda node, data: None) if spec.leaves_document else spec
    if isinstance(spec, dict):
        return {k: _lowered(v) for k, v in spec.items()}
    if isinstance(spec, (list, tuple)) and has_remote(spec):
        return {str(i): _lowered(s) if has_remote(s) else [s] for i, s in enumerate(spec)}
    return spec


def _remote_chains(spec: Any) -> list[Chain]:
    if is_chain(spec):
        return [spec] if spec.leaves_document else []
    parts = spec.values() if isinstance(spec, dict) else spec if isinstance(spec, (list, tuple)) else []
    return [c for p in parts for c in _remote_chains(p)]


def _assembled(spec: Any, local: Column, remote: dict[int, Column]) -> Column:
    if not has_remote(spec):
        return local
    if is_chain(spec):
        return remote[id(spec)]
    if isinstance(spec, dict):
        return F.struct(*[_assembled(v, local[k], remote).alias(k) for k, v in spec.items()])
    as_text = isinstance(type_of(spec).elementType, T.StringType)
    parts = []
    for i, s in enumerate(spec):
        kind = type_of(s) if is_chain(s) or not has_remote(s) and isinstance(s, list) else T.ArrayType(type_of(s))
        part = _assembled(s, local[str(i)], remote)
        part = part if is_chain(s) or not has_remote(s) else F.array_compact(F.array(part))
        if as_text and isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StringType):
            part = F.transform(part, lambda x: F.to_json(x))
        parts.append(F.coalesce(part, F.array().cast(T.ArrayType(T.StringType() if as_text else kind.elementType))))
    return F.concat(*parts)


def _numbered(state: _State) -> _State:
    """Rows with a number of their own, ``_row``, by which nested results find back to them; written,
    so that the numbers stay and nothing above is done again for each nested chain."""
    return _State(_cut(state.df.withColumn("_row", F.monotonically_increasing_id())), state.keep, state.fields)


def _gathered(state: _State, chain: Chain, store: Any) -> tuple[DataFrame, str]:
    """Results of a nested chain by its parent's ``_row``: the number and ``_values``, in order."""
    if chain.keeps_partial:
        raise NotImplementedError("partial() is for nested chains that stay in their document")
    depth = sum(c.startswith("_parent") for c in state.keep)
    row = f"_parent{depth}"
    parents = state.df.select("*", F.col("_row").alias(row)).withColumn("_data", F.lit(None).cast("struct<_:boolean>"))
    parents = parents.drop("_text", "_row", *[c for c in state.keep if not c.startswith("_parent")])
    inner = _State(parents, [c for c in state.keep if c.startswith("_parent")] + [row], T.StructType())
    child = _compile(inner, chain.steps, scoped(store, chain), True)
    if child.fields.fields:
        some = [F.size(F.col("_data")[f.name]) > 0 if isinstance(f.dataType, T.ArrayType) else F.col("_data")[f.name].isNotNull() for f in child.fields.fields]
        value, keep_row = F.col("_data"), F.greatest(*[F.coalesce(s, F.lit(False)) for s in some]) if len(some) > 1 else some[0]
    elif "_text" in child.df.columns:
        value, keep_row = F.col("_text"), F.col("_text").isNotNull()
    else:
        value, keep_row = F.lit(None).cast("string"), F.lit(False)
    rows = child.df.filter(keep_row).select(row, F.struct(F.col("_ord").alias("o"), value.alias("v")).alias("_one"))
    found = rows.groupBy(row).agg(F.transform(F.sort_array(F.collect_list("_one")), lambda x: x["v"]).alias("_values"))
    return found, row


def _joined_fields(state: _State, fields: dict, store: Any) -> _State:
    chains = [c for v in fields.values() for c in _remote_chains(v)]
    state = _numbered(state)
    df, remote = state.df, {}
    for i, chain in enumerate(chains):
        found, row = _gathered(state, chain, store)
        column = f"_values{i}"
        found = found.withColumnRenamed("_values", column)
        df = df.join(found, df["_row"] == found[row], "left").drop(row)
        remote[id(chain)] = F.coalesce(F.col(column), F.array().cast(T.ArrayType(chain.result_type)))
    kinds = {k: type_of(v) for k, v in fields.items()}
    columns = [(_assembled(fields[f.name], F.col("_data")[f.name], remote) if f.name in fields else F.col("_data")[f.name]).alias(f.name) for f in state.fields.fields]
    types = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in state.fields.fields])
    df = df.withColumn("_data", F.struct(*columns)).drop(*[f"_values{i}" for i in range(len(chains))], "_text", "_row")
    return _State(df, state.keep, types)


def _each(values: Column, name: str) -> Column:
    return F.transform(values, lambda v: v[name])


def _joined_do(state: _State, chain: Chain, store: Any) -> _State:
    state = _numbered(state)
    found, row = _gathered(state, chain, store)
    df = state.df.join(found, state.df["_row"] == found[row], "left").drop(row)
    kind, many = chain.data_type, chain.merged_many
    values = F.coalesce("_values", F.array().cast(T.ArrayType(chain.result_type)))
    new = {f.name: F.array_compact(_each(values, f.name)) if many else F.get(values, F.lit(0))[f.name] for f in kind.fields}
    old = [f for f in state.fields.fields if f.name not in new]
    data = F.struct(*[F.col("_data")[f.name].alias(f.name) for f in old], *[c.alias(n) for n, c in new.items()])
    types = T.StructType(old + [T.StructField(f.name, T.ArrayType(f.dataType) if many else f.dataType) for f in kind.fields])
    return _State(df.withColumn("_data", data if old or new else F.col("_data")).drop("_values", "_text", "_row"), state.keep, types)


# ----------------------------------------------------------------------- requests


def _requests_of(step: S.Request, node: Node, data: dict, params: dict, count: int) -> list[dict]:
    """Requests that an operator makes from a context."""

    def made(i: int, url: str, more: dict | None = None, method: str = "get") -> dict:
        own = {k: [str(x) for x in (v if isinstance(v, (list, tuple)) else [v])] for k, v in (more or {}).items()}
        full = urls.with_params(urls.resolve(node.url, url), own) if own else urls.resolve(node.url, url)
        return {"i": i, "method": method, "url": full, "params": list({**urls.params_of(full)}.items()), "error": None}

    def failed(message: str) -> list[dict]:
        return [{"i": 0, "method": None, "url": None, "params": None, "error": message}]

    def of_form(form) -> dict:
        full = urls.with_params(form.url, form.params)
        return {"i": 0, "method": form.method, "url": full, "params": list(form.params.items()), "error": None}

    def called(value):
        return value(node, data) if callable(value) else value

    if step.kind in ("get", "post"):
        url = called(step.target)
        return [made(0, url, called(step.params), step.kind)] if url else failed(f"({step.kind}) no URL")
    if step.kind == "follow":
        found = []
        for i, n in enumerate(node.find(step.target)):
            raw = n.text() if n.ref[1] else n.attr("href") or n.text()
            if raw.strip():
                found.append(made(i, raw))
        return found or failed(f"(follow) no URLs for {step.target}")
    if step.kind == "submit":
        at = node.first(step.target)
        form = form_request(node.doc, at.ref[0], called(step.params)) if at else None
        return [of_form(form)] if form else failed(f"(submit) no form for {step.target}")
    if step.kind == "login":
        form = login_request(node.doc, node.ref[0], *step.target)
        return [of_form(form)] if form else failed("(login) no login form")
    return _next_page(step, node, data, params, count, made, of_form)


def _page_limit(limit: Any, node: Node) -> int | None:
    """How many pages may follow the first; None for any number."""
    if limit is None or limit is True:
        return None
    if callable(limit):
        return _page_limit(limit(node, {}), node)
    if isinstance(limit, str):
        found = node.first(limit)
        return urls.leading_integer(found.text()) if found else 0
    return int(limit)


def _added(text: str, by: int | float) -> str:
    """A parameter's number and ``by``, as exact as decimals are; what is no number counts as 0."""
    try:
        total = Decimal(text or "0") + Decimal(str(by))
    except InvalidOperation:
        total = Decimal(str(by))
    return f"{total.normalize():f}" if total else "0"


def _next_page(step: S.Request, node: Node, data: dict, params: dict, count: int, made, of_form) -> list[dict]:
    limit = _page_limit(step.limit, node)
    if limit is not None and count > limit:
        return []
    target = step.target(node, data) if callable(step.target) else step.target
    if target is None or target is False:
        return []
    page = (node.url or "").split("#")[0]
    params = params or urls.params_of(page)  # pages of a table were asked for by their URL
    if isinstance(target, dict):
        new = {}
        for name, value in target.items():
            if isinstance(value, str) and not callable(step.target):
                found = node.first(value)
                if found is None:
                    return []
                new[name] = found.content()
            elif isinstance(value, (int, float)) and not callable(step.target):
                new[name] = _added(params.get(name, ["0"])[-1], value)
            else:
                new[name] = value
        return [made(0, page, new)]
    if callable(step.target):
        return [made(0, target)]
    found = node.first(target)
    if found is None:
        return []
    tag = found.doc.name[found.ref[0]]
    if found.ref[1] is None and tag in ("form", "button", "input"):
        name = found.attr("name")
        if tag == "input" and found.attr("type") not in ("submit", "image") and name:
            return [made(0, page, {name: found.attr("value") or ""})]
        form = form_request(found.doc, found.ref[0])
        return [of_form(form)] if form else []
    url = found.text() if found.ref[1] else found.attr("href") or link_of(found.doc, found.ref[0]) or found.text()
    return [made(0, url)] if url.strip() else []


def _asked(state: _State, step: S.Request, errors: list[DataFrame] | None) -> DataFrame:
    """Rows with the requests they make: ``_rurl, _method, _nparams, _ri``."""
    keep = [f"`{c}`" for c in state.keep]
    if isinstance(step.target, Column):
        if step.params is not None:
            raise ValueError("a column as target holds its parameters itself")
        url = F.when(F.col("_url").isNotNull() & step.target.startswith("/") & ~step.target.startswith("//"), F.concat(F.regexp_extract("_url", "^(https?://[^/]+)", 1), step.target)).otherwise(step.target)
        return state.df.select(*keep, *_BASE, "_data", url.alias("_rurl"), F.lit(step.kind).alias("_method"), F.lit(None).cast(_PARAMS).alias("_nparams"), F.lit(0).alias("_ri"))
    result, reads = T.ArrayType(_REQUEST), bool(state.fields.fields)
    arrow = _arrow(result)

    @F.arrow_udf(result)
    def requests(html: pa.Array, url: pa.Array, node: pa.Array, attr: pa.Array, before: pa.Array, params: pa.Array, count: pa.Array) -> pa.Array:
        out = []
        for h, u, n, a, b, p, c in zip(*(x.to_pylist() for x in (html, url, node, attr, before, params, count)), strict=True):
            start = Node(parsed(h or "", u), (n, a))
            out.append(_requests_of(step, start, json.loads(b) if b else {}, dict(p or []), c))
        return pa.array(out, arrow)

    before = F.to_json("_data") if reads else F.lit(None).cast("string")
    made = state.df.select(*keep, *_BASE, "_data", F.explode_outer(requests("_html", "_url", "_node", "_attr", before, "_rparams", "_count")).alias("_q"))
    if errors is not None:
        errors.append(made.filter("_q.error is not null").select("_src", F.col("_q.error").alias("message")))
    return made.filter("_q.url is not null").select(*keep, *_BASE, "_data", F.col("_q.url").alias("_rurl"), F.col("_q.method").alias("_method"), F.col("_q.params").alias("_nparams"), F.col("_q.i").alias("_ri"))


def _requested(state: _State, step: S.Request, store: Any, errors: list[DataFrame] | None, counted: bool = False) -> _State:
    if store is None:
        raise ValueError(f"{step.kind}() loads documents: give to_df() a store of pages")
    # The parent's markup isn't needed any more and doesn't travel through the join.
    asked = _asked(state, step, errors).drop("_html")
    if errors is not None:
        missed = store.answer(asked, outer=True).filter(~F.coalesce(store.good(), F.lit(False)))
        reason = F.when(F.col("_nhtml").isNull(), "not found").when(F.length("_nhtml") == 0, "Data is empty").otherwise(F.concat(F.lit("status "), F.col("_status").cast("string")))
        errors.append(missed.select("_src", F.concat(F.lit(f"({step.kind}) "), F.col("_rurl"), F.lit(": "), reason).alias("message")))
    got = store.answer(asked)
    count = F.col("_count") + 1 if counted else F.lit(1)
    df = got.select(*[f"`{c}`" for c in state.keep], "_src", F.concat("_ord", F.array("_ri")).alias("_ord"), F.col("_nurl").alias("_url"), F.col("_nhtml").alias("_html"), F.lit(0).alias("_node"), F.lit(None).cast("string").alias("_attr"), F.col("_nparams").alias("_rparams"), count.alias("_count"), "_data")
    return _State(df, state.keep, state.fields)


def _paginated(state: _State, step: S.Request, store: Any, errors: list[DataFrame] | None) -> _State:
    """The current pages and those after them, level by level.

    Each level is written before the next is asked for, so a page is parsed and looked up once,
    however many levels follow. The loop ends with the first empty level or at the limit. Where
    neither a limit nor the pages end it, more than ``max_pages`` pages are an error.
    """
    fixed = isinstance(step.limit, int) and not isinstance(step.limit, bool)
    most = step.limit if fixed else step.options["max_pages"] - 1
    columns = [f"`{c}`" for c in state.keep] + [*_BASE, "_data"]
    level = _State(_cut(state.df.select(*columns)), state.keep, state.fields)
    levels = [level.df]
    for _ in range(most):
        level = _requested(level, step, store, errors, counted=True)
        level.df = _cut(level.df.select(*columns))
        if level.df.isEmpty():
            break
        levels.append(level.df)
    else:
        if not fixed and not _asked(level, step, None).isEmpty():
            raise RuntimeError(f"paginate() goes on after {step.options['max_pages']} pages: give a limit, or max_pages")
    paths = [x._webweft_path for x in levels]
    out = levels[0].sparkSession.read.schema(levels[0].schema).parquet(*paths)
    return _State(out, state.keep, state.fields)


def _cut(df: DataFrame) -> DataFrame:
    """Write rows into the folder that spark.checkpoint.dir names and read them back: what was fetched
    is fetched once, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="webweft-")
        spark.sparkContext.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/webweft-rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._webweft_path = path
    return out


def starter(name: str) -> Callable[..., Chain]:
    """A chain's method as a function that begins a new chain."""

    def begin(*args: Any, **options: Any) -> Chain:
        return getattr(Chain(), name)(*args, **options)

    begin.__name__ = name
    begin.__doc__ = getattr(Chain, name).__doc__
    return begin
