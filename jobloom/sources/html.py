"""HTML extraction (S5, S6, X24): Python splits pages into narrow rows, Spark chooses among them.

``with_nodes`` hands out a page's elements and texts in document order (``mapInArrow``, standard-library
parser, bounded batches).  A node knows its place ``pos``, the place ``end`` of the last node inside it
and its ``parent``, so what lies inside an element is a range.  Cards, fields and links are expressions
on that array: no shuffle, and a column that nobody asks for isn't computed.
"""

from __future__ import annotations

import functools
import operator
import re
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from jobloom.functions.dates import posted
from jobloom.functions.text import job_id
from jobloom.functions.web import job_url_from_key, remote_type

# fixed values: elements that hold nothing
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BATCH_NODES = 50_000
_I, _S = T.IntegerType(), T.StringType()
NODE = T.StructType([T.StructField(n, t) for n, t in (
    ("pos", _I), ("end", _I), ("parent", _I), ("tag", _S), ("attrs", T.MapType(_S, _S)), ("text", _S),
    ("up", T.ArrayType(_I)))])
CARD_FIELDS = ["title", "job_key", "company", "location", "description", "posted_text", "salary", "job_url",
               "company_url", "company_url_direct"]


# ------------------------------------------------------------------ pages → nodes
# What stands between < and > in a tag, comment or doctype, written as most pages write them.  The parser
# reads these in the same way, but several times slower; whatever looks otherwise is left to it.
_HEAD = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_:.]*(?:="[^"]*")?)*)[ \t\n\r\f]*(/?)
    |!--[^-]*--|![dD][oO][cC][tT][yY][pP][eE].*""", re.VERBOSE | re.DOTALL)
_ATTR = re.compile(r'([a-zA-Z][-a-zA-Z0-9_:.]*)(?:="([^"]*)")?')
_CDATA_END = {t: re.compile(rf"/\s*{t}\s*>", re.I) for t in HTMLParser.CDATA_CONTENT_ELEMENTS}
_NO_ATTRS, _NO_UP = {}, ()


@functools.lru_cache(4096)
def _head(text: str) -> tuple | None:
    """(end tag?, tag, attributes, holds nothing?); no tag for what counts for nothing, None for the parser's."""
    m = _HEAD.fullmatch(text)
    if not m or m[1] and (m[3] or m[4]):
        return None
    tag = m[2] and m[2].lower()
    attrs = {k.lower(): unescape(v) for k, v in _ATTR.findall(m[3])} if m[3] else _NO_ATTRS
    return bool(m[1]), tag, attrs, bool(m[4]) or tag in VOID


class _Splitter(HTMLParser):
    """Appends a page's nodes to the columns of a batch.  An end tag ends all elements opened since its
    start tag, one without a start tag is skipped, and the page's end ends the rest."""

    def __init__(self, cols: dict):
        super().__init__(convert_charrefs=True)
        self.cols, self.first, self.open = cols, len(cols["pos"]), []
        self.pos, self.ends, self.parents, self.tags, self.attrs, self.texts, self.ups = (cols[n] for n in NODE.names)

    def updatepos(self, i, j):
        return j                                    # line numbers aren't asked for

    def _add(self, tag, attrs, text) -> int:
        pos, opened = len(self.pos) - self.first, self.open
        self.pos.append(pos)
        self.ends.append(pos)
        self.parents.append(opened[-1] if opened else -1)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.texts.append(text)
        # an element with a link names the elements around it that have attributes, innermost first
        self.ups.append([p for p in reversed(opened) if self.attrs[self.first + p]] if "href" in attrs else ())
        return pos

    def handle_startendtag(self, tag, attrs):
        return self._add(tag, {k: v or "" for k, v in attrs}, None)

    def handle_starttag(self, tag, attrs):
        pos = self.handle_startendtag(tag, attrs)
        if tag not in VOID:
            self.open.append(pos)

    def handle_endtag(self, tag):
        first, tags, last = self.first, self.tags, len(self.pos) - self.first - 1
        for i in range(len(self.open) - 1, -1, -1):
            if tags[first + self.open[i]] == tag:
                for p in self.open[i:]:
                    self.ends[first + p] = last
                del self.open[i:]
                return

    def handle_data(self, data):
        text = data.strip()
        if text:
            self._add(None, {}, text)

    def _plain(self, html: str) -> int:
        """Adds the nodes of the page's plain beginning; the place where the parser has to go on."""
        first, opened, tags, ends, n = self.first, self.open, self.tags, self.ends, 0
        pos, parent, attrs_of, texts, up = (c.append for c in (self.pos, self.parents, self.attrs, self.texts, self.ups))
        parts, k, text = html.split("<"), 0, None
        while True:
            if k:
                head, whole, text = parts[k].partition(">")
                known = _head(head) if whole else None
                if known is None:
                    break
                close, tag, attrs, empty = known
                cdata = _CDATA_END.get(tag) if not close and not empty else None
                if cdata:                           # only its own end tag ends it
                    j = next((j for j in range(k + 1, len(parts)) if cdata.match(parts[j])), None)
                    if j is None or not parts[j].startswith(f"/{tag}>"):
                        break
                if close:
                    if opened and tags[first + opened[-1]] == tag:
                        ends[first + opened.pop()] = n - 1
                    else:
                        self.handle_endtag(tag)
                elif tag:
                    pos(n)
                    ends.append(n)
                    parent(opened[-1] if opened else -1)
                    tags.append(tag)
                    attrs_of(attrs)
                    texts(None)
                    up([p for p in reversed(opened) if self.attrs[first + p]] if "href" in attrs else _NO_UP)
                    if not empty:
                        opened.append(n)
                    n += 1
                if cdata:
                    text, k = "<".join([text, *parts[k + 1:j]]), j - 1
                elif "&" in text:
                    text = unescape(text)
            else:
                text = unescape(parts[0])
            text = text.strip()
            if text:
                pos(n)
                ends.append(n)
                parent(opened[-1] if opened else -1)
                tags.append(None)
                attrs_of(_NO_ATTRS)
                texts(text)
                up(_NO_UP)
                n += 1
            k += 1
            if k == len(parts):
                return len(html)
        return sum(map(len, parts[:k])) + k - 1

    def split(self, html: str) -> None:
        try:
            self.feed(html[self._plain(html):])
            self.close()
        except AssertionError:      # the parser's answer to a broken declaration: what came before counts
            pass
        for p in self.open:
            self.ends[self.first + p] = len(self.pos) - self.first - 1


def _arrow(cols: dict, offsets: list) -> pa.Array:
    """The nodes of a batch as an array column."""
    def cuts(lists):
        return pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32())
    flat = chain.from_iterable
    ints = [pa.array(cols[n], pa.int32()) for n in ("pos", "end", "parent")]
    attrs = pa.MapArray.from_arrays(cuts(cols["attrs"]), pa.array(list(flat(cols["attrs"])), pa.string()),
                                    pa.array(list(flat(a.values() for a in cols["attrs"])), pa.string()))
    up = pa.ListArray.from_arrays(cuts(cols["up"]), pa.array(list(flat(cols["up"])), pa.int32()))
    values = [*ints, pa.array(cols["tag"], pa.string()), attrs, pa.array(cols["text"], pa.string()), up]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, NODE.names))


def with_nodes(pages: DataFrame) -> DataFrame:
    """``pages`` with an array of nodes for ``html``; a null html has none."""
    keep = [f for f in pages.schema.fields if f.name not in ("html", "nodes")]

    def run(batches):
        for batch in batches:
            start, cols, offsets = 0, {n: [] for n in NODE.names}, [0]
            for i, html in enumerate(batch.column("html"), 1):
                _Splitter(cols).split(html.as_py() or "")
                offsets.append(len(cols["pos"]))
                if offsets[-1] >= BATCH_NODES or i == batch.num_rows:
                    part = batch.slice(start, i - start)
                    yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), _arrow(cols, offsets)],
                                                     names=[*(f.name for f in keep), "nodes"])
                    start, cols, offsets = i, {n: [] for n in NODE.names}, [0]
    return pages.select(*[f.name for f in keep], "html").mapInArrow(
        run, T.StructType([*keep, T.StructField("nodes", T.ArrayType(NODE))]))


# ------------------------------------------------------------------ expressions on nodes
def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def _within(nodes: Column, el: Column, f, kind: T.DataType) -> Column:
    """``f`` of each node inside an element, by places: the rest of the page isn't touched."""
    def of(e):
        places = F.sequence(e["pos"] + 1, e["end"])     # counts down where nothing is inside
        return F.when(e["end"] > e["pos"], F.transform(places, lambda i: f(F.get(nodes, i)))) \
            .when(e.isNotNull(), F.array().cast(T.ArrayType(kind)))
    return let(el, of)


def inside(nodes: Column, el: Column) -> Column:
    return _within(nodes, el, lambda n: n, NODE)


def elements(nodes: Column) -> Column:
    """Without the texts, which no test of a tag or an attribute finds."""
    return F.filter(nodes, lambda n: n["tag"].isNotNull())


def text_of(nodes: Column, el: Column) -> Column:
    """The joined texts inside an element; null without one."""
    return F.array_join(_within(nodes, el, lambda n: n["text"], _S), "")


def attr(n: Column, name: str) -> Column:
    return n["attrs"][name]


def is_a(tag: str | None = None, cls: str | None = None, **attrs: str):
    """A test of a node: its tag, a class, attribute values (``_`` stands for ``-``)."""
    def test(n):
        tests = [n["tag"] == tag] if tag else [n["tag"].isNotNull()]
        tests += [attr(n, "class").rlike(rf"(^|\s){re.escape(cls)}(\s|$)")] if cls else []
        tests += [attr(n, k.replace("_", "-")) == v for k, v in attrs.items()]
        return F.coalesce(functools.reduce(operator.and_, tests), F.lit(False))
    return test


_TESTS = {None: lambda a, v: a.isNotNull(), "=": lambda a, v: a == v, "*=": Column.contains,
          "^=": Column.startswith, "$=": Column.endswith}


def _compound(text: str):
    """The test of ``tag.class[attr]``; an attribute may have a value with =, *=, ^= or $=."""
    m = re.fullmatch(r"([\w-]+|\*)?((?:\.[\w-]+|\[[^\]]+\])*)", text)
    if not m:
        raise ValueError(f"unsupported selector: {text}")
    parts = re.findall(r"\.([\w-]+)|\[([\w-]+)(?:([*^$]?=)['\"]?([^'\"\]]*)['\"]?)?\]", m[2])
    tests = [is_a(None if m[1] in (None, "*") else m[1])]
    tests += [is_a(cls=c) if c else
              lambda n, a=a, op=op, v=v: F.coalesce(_TESTS[op or None](attr(n, a), v), F.lit(False))
              for c, a, op, v in parts]
    return lambda n: functools.reduce(operator.and_, [t(n) for t in tests])


def select(nodes: Column, selector: str) -> Column:
    """The nodes that a selector list names, in page order; ancestors count among ``nodes`` only."""
    def below(above, child, test):
        return lambda n: test(n) & F.exists(
            above, lambda m: (n["parent"] == m["pos"]) if child else (m["pos"] < n["pos"]) & (n["pos"] <= m["end"]))

    def steps(tokens, rest, tests, above=None):
        """Binds the nodes that each step but the last finds, then tests all nodes once."""
        child, tokens = tokens[0] == ">", tokens[tokens[0] == ">":]
        test = _compound(tokens[0]) if above is None else below(above, child, _compound(tokens[0]))
        if len(tokens) > 1:
            return let(F.filter(nodes, test), lambda found: steps(tokens[1:], rest, tests, found))
        if rest:
            return steps(rest[0], rest[1:], [*tests, test])
        return F.filter(nodes, lambda n: functools.reduce(operator.or_, [t(n) for t in [*tests, test]]))
    lists = [alt.replace(">", " > ").split() for alt in selector.split(",")]
    return steps(lists[0], lists[1:], [])


# ------------------------------------------------------------------ cards
def _card(get) -> Column:
    return F.struct(*[F.coalesce(get.get(n, F.lit(None)), F.lit(None).cast("string")).alias(n) for n in CARD_FIELDS])


def _dom_cards(nodes: Column) -> Column:
    """The search-page card rule; cards without a title link are skipped."""
    def card(el):
        def of(inner):
            text = lambda test, default: F.coalesce(text_of(nodes, first(F.filter(inner, test))), F.lit(default))
            link = first(F.filter(inside(nodes, first(F.filter(inner, is_a("h2", "jobTitle")))), is_a("a")))
            return let(link, lambda a: F.when(a.isNotNull(), _card({
                "title": text_of(nodes, a),
                "job_key": F.coalesce(F.nullif(attr(a, "data-jk"), F.lit("")),
                                      F.nullif(F.replace(attr(a, "id"), F.lit("job_"), F.lit("")), F.lit(""))),
                "company": text(is_a("span", data_testid="company-name"), "Unknown"),
                "location": text(is_a("div", data_testid="text-location"), "Remote"),
                "description": text(is_a("div", "job-snippet"), ""),
                "posted_text": text(is_a("span", "date"), "")})))
        return let(elements(inside(nodes, el)), of)
    cards = F.filter(nodes, lambda n: (n["tag"] == "div") & attr(n, "class").contains("job_seen_beacon"))
    return F.filter(F.transform(cards, card), lambda c: c.isNotNull())


def _selector_cards(nodes: Column, spec: dict) -> Column:
    """Declarative fields relative to every base element."""
    def field(inner, f):
        value = (lambda hit: attr(hit, f["attribute"])) if f.get("type") == "attribute" \
            else (lambda hit: text_of(nodes, hit))
        return let(first(select(inner, f["selector"])), value)
    return F.transform(select(nodes, spec["base"]), lambda el: let(
        elements(inside(nodes, el)), lambda inner: _card({f["name"]: field(inner, f) for f in spec["fields"]})))


def with_cards(pages: DataFrame, mode: str = "dom", spec: dict | None = None, column: str = "cards") -> DataFrame:
    """``pages`` without ``html`` and with an array of its job cards, each with its place ``pos``."""
    keep = [c for c in pages.columns if c not in ("html", column)]
    found = _dom_cards(F.col("nodes")) if mode == "dom" else _selector_cards(F.col("nodes"), spec)
    placed = F.transform(found, lambda c, i: F.struct(i.alias("pos"), *[c[n].alias(n) for n in CARD_FIELDS]))
    return with_nodes(pages).select(*keep, placed.alias(column))


def extract_cards(pages: DataFrame, mode: str = "dom", spec: dict | None = None) -> DataFrame:
    """Job cards of every page: one row per card, in page order (``pos``)."""
    # an outer generator: a plain one has the optimiser test the array first, by computing it again
    return with_cards(pages.select("page_id", "html"), mode, spec) \
        .select("page_id", F.inline_outer("cards")).where(F.col("pos").isNotNull())


def card_job(c: Column, as_of, board: str = "indeed") -> list[Column]:
    """The job columns of a card."""
    return [job_id(c.company, c.title, c.location, c.job_key).alias("id"), c.title.alias("title"),
            c.company.alias("company"), c.location.alias("location"),
            c.description.alias("description"), job_url_from_key(c.job_key).alias("url"),
            posted(c.posted_text, as_of),
            F.lit(board).alias("board_source"), remote_type(c.location).alias("remote_type")]


def dom_to_jobs(cards: DataFrame, as_of, board: str = "indeed") -> DataFrame:
    """Job rows of the extracted cards."""
    c = F.struct(*[F.col(n) for n in cards.columns])
    return cards.select("page_id", "pos", *card_job(c, as_of, board))


# ------------------------------------------------------------------ link list
LINK_FIELDS = ["href", "text", "testid", "container", "parent_text", "sections"]


def _link(nodes: Column, n: Column, columns: list[str]) -> Column:
    some = lambda x, name: F.coalesce(attr(x, name), F.lit(""))
    around = F.transform(n["up"], lambda i: F.get(nodes, i))
    holder = first(F.filter(around, lambda m: (some(m, "data-testid") != "") | (some(m, "class") != "")))
    boxes = F.filter(around, lambda m: m["tag"].isin("div", "section") & (some(m, "class") != ""))
    page = F.struct(F.lit(-1).alias("pos"), (F.size(nodes) - 1).alias("end"))
    parent = let(F.get(nodes, n["parent"]), lambda p: F.struct(
        F.coalesce(p["pos"], page["pos"]).alias("pos"), F.coalesce(p["end"], page["end"]).alias("end")))
    fields = {
        "href": attr(n, "href"), "text": text_of(nodes, n), "testid": attr(n, "data-testid"),
        "container": let(holder, lambda m: F.when(m.isNotNull(), F.concat_ws(
            "|", m["tag"], some(m, "data-testid"), some(m, "class")))),
        "parent_text": let(parent, lambda p: text_of(nodes, p)),
        "sections": F.array_join(F.transform(boxes, lambda m: attr(m, "class")), "\n")}
    return F.struct(*[fields[c].alias(c) for c in columns])


def extract_links(pages: DataFrame, columns: list[str] = LINK_FIELDS) -> DataFrame:
    """Every ``<a href>`` of every page with its text and context: ``container`` is the nearest
    element around it with a test id or class, as 'tag|testid|class', and ``sections`` the classes of all
    divs and sections around it, innermost first, one a line.  Only the wanted columns are computed."""
    nodes = F.col("nodes")
    links = F.filter(nodes, lambda x: (x["tag"] == "a") & attr(x, "href").isNotNull())
    found = F.transform(links, lambda n: _link(nodes, n, columns))
    return with_nodes(pages.select("page_id", "html")).select("page_id", F.posexplode_outer(found).alias("pos", "l")) \
        .where(F.col("pos").isNotNull()).select("page_id", "pos", "l.*")
