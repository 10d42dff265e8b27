"""Trees against the standard parser's events and against trees they were written from, selectors against a plain matcher, readers on pages of the real shape."""

import random
from html import escape
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from boutline.sources import html, readers
from boutline.sources.html import RAW, VOID, Tree


class Events(HTMLParser):
    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.starts, self.data = [], []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.starts.append((tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_data(self, data):
        self.data.append(data)


def elements(tree):
    return [(t, a) for t, a in zip(tree.tags, tree.attrs) if a is not None]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_against_the_standard_parser(sf):
    """Start tags with attributes, and all text, of the whole table of pages."""
    for r in pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pylist():
        tree, plain = Tree(r["html"]), Events(r["html"])
        assert elements(tree) == plain.starts
        assert "".join(x for x in tree.texts if x) == "".join(plain.data)


def nested(tree):
    """The tree as nested lists [tag, attrs, children]; texts are strings."""

    def children(k, end):
        out = []
        while k <= end:
            out.append(tree.texts[k] if tree.texts[k] is not None else [tree.tags[k], tree.attrs[k], children(k + 1, tree.last[k])])
            k = tree.last[k] + 1
        return out

    return children(0, len(tree.tags) - 1)


def made(rng, depth=0):
    """A random tree, without what a start tag would end."""
    if depth > 5 or rng.random() < 0.3:
        return rng.choice(["text", "a < b & c", "é\n x", "  "])
    kind = rng.choice(["div", "ul", "table", "span", "br", "script", "dl", "select"])
    attrs = {k: rng.choice(["", "v", "a b", "<&\"'>", "é"]) for k in rng.sample(["class", "id", "data-x", "href"], rng.randrange(3))}
    some = lambda: [made(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind == "ul":
        return [kind, attrs, [["li", {}, some()] for _ in range(rng.randrange(3))]]
    if kind == "dl":
        return [kind, attrs, [[rng.choice(["dt", "dd"]), {}, some()] for _ in range(rng.randrange(3))]]
    if kind == "select":
        return [kind, attrs, [["option", {"value": "1"}, ["x"]] for _ in range(rng.randrange(3))]]
    if kind == "table":
        return [kind, attrs, [["tbody", {}, [["tr", {}, [[rng.choice(["td", "th"]), {}, some()] for _ in range(rng.randrange(3))]] for _ in range(rng.randrange(1, 3))]]]]
    if kind == "br":
        return [kind, attrs, []]
    if kind == "script":
        return [kind, attrs, ['if (a < b) "</td>" && x']]
    return [kind, attrs, some()]


def merged(nodes):
    """Neighbouring texts as one."""
    out = []
    for n in nodes:
        if isinstance(n, str):
            if out and isinstance(out[-1], str):
                out[-1] += n
            else:
                out.append(n)
        else:
            out.append([n[0], n[1], merged(n[2])])
    return out


def written(rng, n, short):
    """Markup of a tree; `short` leaves out what may be left out."""
    if isinstance(n, str):
        return escape(n, quote=False)
    tag, attrs, inner = n
    quoted = "".join(f" {k}" if not v and short else f" {k}={v}" if short and v.isalnum() else f" {k}='{escape(v)}'" if rng.random() < 0.5 else f' {k} = "{escape(v)}"' for k, v in attrs.items())
    name = tag.upper() if rng.random() < 0.2 else tag
    body = inner[0] if tag in RAW and inner else "".join(written(rng, x, short) for x in inner)
    if tag in VOID:
        return f"<{name}{quoted}{'/' if rng.random() < 0.5 and not short else ''}>"
    if short and tag == "tbody" and not attrs:
        return body
    end = "" if short and tag in ("li", "dt", "dd", "option", "td", "th", "tr") else f"</{name}>"
    return f"<{name}{quoted}>{body}{end}{'<!-- <p> -->' if rng.random() < 0.1 else ''}"


@pytest.mark.parametrize("short", [False, True])
def test_trees_come_back(short):
    rng = random.Random(8)
    for _ in range(400):
        want = [["div", {}, [made(rng) for _ in range(3)]]]
        assert merged(nested(Tree(written(rng, want[0], short)))) == merged(want)


@pytest.mark.parametrize(
    "markup, want",
    [
        ("", []),
        ("a < b <3 </ x>c<", ["a < b <3 c<"]),
        ("<p>a<p>b<div>c</p>d</div>", [["p", {}, ["a"]], ["p", {}, ["b"]], ["div", {}, ["cd"]]]),
        ("<table><td>a<td>b<table><tr><td>in</table>c<tr><td>d</table>e", [["table", {}, [["tbody", {}, [["tr", {}, [["td", {}, ["a"]], ["td", {}, ["b", ["table", {}, [["tbody", {}, [["tr", {}, [["td", {}, ["in"]]]]]]]], "c"]]]], ["tr", {}, [["td", {}, ["d"]]]]]]]], "e"]),
        ("<table><tr><td><b>x</table>y</b>", [["table", {}, [["tbody", {}, [["tr", {}, [["td", {}, [["b", {}, ["x"]]]]]]]]]], "y"]),
        ("<div><table><tr><td></div>in</table>out</div>", [["div", {}, [["table", {}, [["tbody", {}, [["tr", {}, [["td", {}, ["in"]]]]]]]], "out"]]]),
        ("<ul><li>1<ul><li>2</ul><li>3</ul>", [["ul", {}, [["li", {}, ["1", ["ul", {}, [["li", {}, ["2"]]]]]], ["li", {}, ["3"]]]]]),
        ("<a href='x", []),
        ("<a href=\"x>y</a>", [["a", {"href": "", "\"x": ""}, ["y"]]]),
        ("<i a=1 a=2 /b>z", [["i", {"a": "1", "b": ""}, ["z"]]]),
        ("<!doctype html><?xml x?><!-- a -- > <b> --><script>x</scripty></script >t<title>a&amp;<b></title>", [["script", {}, ["x</scripty>"]], "t", ["title", {}, ["a&<b>"]]]),
        ("<!-- open <b>", []),
        ("</br>&amp;&#233;&bogus;", [["br", {}, []], "&é&bogus;"]),
        ("</td></p><b>x", [["b", {}, ["x"]]]),
    ],
)
def test_broken_markup(markup, want):
    assert merged(nested(Tree(markup))) == want


def test_deep_and_long_pages():
    """Depth and odd quotes cost no more than their length."""
    deep = Tree("<div>" * 50_000 + "<p>x" + "<span>" * 50_000)
    assert deep.last[0] == len(deep.tags) - 1 == 100_001
    assert len(Tree("<a b='" * 20_000).tags) <= 20_000 and len(Tree("<" * 100_000).tags) == 100_000 and len(Tree("</b>" * 100_000).tags) == 0


PLAIN = {
    "div": [[("div", lambda a, c: True)]],
    ".a": [[("", lambda a, c: "a" in c)]],
    'div[class="v"], span[id], #v': [[("div", lambda a, c: a.get("class") == "v")], [("span", lambda a, c: "id" in a)], [("", lambda a, c: a.get("id") == "v")]],
    "div div span": [[("div", lambda a, c: True), ("div", lambda a, c: True), ("span", lambda a, c: True)]],
    'table td[data-x], li .b, div [href^="<"]': [[("table", lambda a, c: True), ("td", lambda a, c: "data-x" in a)], [("li", lambda a, c: True), ("", lambda a, c: "b" in c)], [("div", lambda a, c: True), ("", lambda a, c: a.get("href", "").startswith("<"))]],
    '[href*="&"], [class$="b"], [class~="b"]': [[("", lambda a, c: "&" in a.get("href", ""))], [("", lambda a, c: a.get("class", "").endswith("b"))], [("", lambda a, c: "b" in c)]],
    "div:not(.a):not([id]) ul, table:not(#v)": [[("div", lambda a, c: "a" not in c and "id" not in a), ("ul", lambda a, c: True)], [("table", lambda a, c: a.get("id") != "v")]],
}


def plain_find(tree, chains, low=0, high=None):
    found, nodes = set(), [k for k in range(low, len(tree.tags) if high is None else high + 1) if tree.attrs[k] is not None]
    fits = lambda k, part: (not part[0] or tree.tags[k] == part[0]) and part[1](tree.attrs[k], tree.attrs[k].get("class", "").split())
    for chain in chains:
        level = [k for k in nodes if fits(k, chain[0])]
        for part in chain[1:]:
            level = [k for k in nodes if fits(k, part) and any(m < k <= tree.last[m] for m in level)]
        found |= set(level)
    return sorted(found)


def test_selectors_against_a_plain_matcher():
    rng, hits = random.Random(2), 0
    for n in range(300):
        tree = Tree("".join(written(rng, made(rng), n % 2 == 0) for _ in range(6)))
        for selector, chains in PLAIN.items():
            found = tree.find(selector)
            assert found == plain_find(tree, chains)
            hits += len(found)
            for outer in tree.find("div, td")[:3]:
                assert tree.find(selector, outer) == plain_find(tree, chains, outer + 1, tree.last[outer])
    assert hits > 1000
    for bad in ("div >", "", "a:hover", ':not([a="b"])', "a,"):
        with pytest.raises(ValueError):
            Tree("").find(bad)


def test_fields():
    page = '<div class="a" id="v"><span class="b" href="/x/1">o<br>ne<em>t</em></span><span class="b">two</span></div><p title="t">x</p>'
    tree = Tree(page)
    take = lambda path, node=None, **what: html.Field(tuple(path), **what).of(tree, node)
    div = tree.find("div")[0]
    assert [take([("span", k)], div) for k in (0, 1, 2, -1, -2, -3)] == ["onet", "two", None, "two", "onet", None]
    assert take([("span", 0)], div, breaks=True, without="em") == "o ne" and take([("/p", 0)], div) == "x" and take([("em", 0), ("..", 0)], div, attr="href") == "/x/1"
    assert take([("span", 0)], div, count=True) == 2 and take([("i", 0), ("b", 0)], div, count=True) == 0 and take([("span", 0)], div, every=True, attr="href") == ["/x/1", None]
    assert take([("i", 0), ("b", 0)], every=True) == [] and take([], div, attr="id") == "v" and take([]) is None and take([("p", 0)], div) is None and take([("p", 0)]) == "x"


def test_extract(spark):
    pages = [(1, "<li>a<li class=x>b", "kept", 5), (1, "<li>a<li class=x>b", "kept", 5), (2, None, None, None), (3, "", "k", 1), (4, "<p>none", "k", 1)]
    d = spark.createDataFrame(pages, "page long, markup string, extra string, position int")
    fields = {"text": html.Field(), "all": html.Field((("/li", 0),), every=True), "n": html.Field((("/li", 0),), count=True)}
    rules = {"item": html.Rows("li", fields), "marked": html.Rows("li.x", fields), "page": html.Rows(None, {**fields, "text": html.Field((("li", 1),))}), "first": html.Rows("li, p", fields, first=True)}
    rows = html.extract(d, "markup", rules)
    assert rows.columns == ["page", "extra", "rule", "position", "text", "all", "n"]
    got = sorted((r["page"], r["rule"], r["position"], r["text"], tuple(r["all"]), r["n"], r["extra"]) for r in rows.collect())
    own = [(1, "first", 0, "a"), (1, "item", 0, "a"), (1, "item", 1, "b"), (1, "marked", 0, "b"), (1, "page", 0, "b")]
    want = [(*r, ("a", "b"), 2, "kept") for r in own for _ in range(2)] + [(2, "page", 0, None, (), 0, None), (3, "page", 0, None, (), 0, "k"), (4, "first", 0, "none", (), 0, "k"), (4, "page", 0, None, (), 0, "k")]
    assert got == sorted(want, key=lambda r: r[:3])
    assert html.extract(d.limit(0), "markup", rules).count() == 0
    with pytest.raises(ValueError):
        html.extract(d, "markup", {"a": html.Rows(None, fields), "b": html.Rows(None, {"text": html.Field()})})


def one(spark, markup):
    return spark.createDataFrame([(1, markup)], "page long, html string")


def test_readers_of_other_pages(spark):
    """A page of another kind, an empty one and a missing one: no bouts, or a row without values."""
    d = spark.createDataFrame([(1, "<p>nothing</p>"), (2, ""), (3, None)], "page long, html string")
    base = "https://s.example"
    for rows in (readers.bouts(d, "html", base), readers.histories(d, "html", base), readers.fight_sides(d, "html"), readers.fight_rounds(d, "html"), readers.completed_events(d, "html"), readers.fight_links(d, "html")):
        assert rows.count() == 0
    assert {(r["name"], r["date"], r["start_time"], r["location"]) for r in readers.events(d, "html").collect()} == {("", None, None, "")}
    assert {tuple(r)[1:] for r in readers.fighters(d, "html", base).collect()} == {("", "", "", 0, 0, 0, None, None)}
    assert {tuple(r)[1:] for r in readers.fight_meta(d, "html").collect()} == {("", False, "", 0, "", 0)}
    assert {tuple(r)[1:] for r in readers.physiques(d, "html").collect()} == {(None, None, None)}
    assert {tuple(r)[1:] for r in readers.event_meta(d, "html").collect()} == {("", "", "")}


def test_reader_rules(spark):
    """Dates with an event's own link, heads and short rows, the second counter, badges that mean nothing, control times."""
    history = """<div class="module fight_history"><table class="new_table fighter"><tbody><tr class="table_head"><td>R</td><td>O</td><td>E</td><td>M</td><td>R</td><td>T</td></tr>
    <tr><td><span class="final_result win">Win</span></td><td><a href="/fighter/B-1">B One</a></td><td><a href="/events/E-2"><span itemprop="award">E 2</span></a><br><span class="sub_line">Sep / 20 / 2013</span></td><td class="winby"><b>KO (Kick)</b><br><span class="sub_line"><a>Ref</a></span></td><td>2</td><td>4:33</td></tr>
    <tr><td><span class="final_result draw">Draw</span></td><td><a href="javascript:void();">C Two</a></td><td><a href="http://o.example/E">E 3</a><span class="sub_line">sometime</span></td><td></td><td>N/A</td><td></td></tr>
    <tr><td></td><td><a></a></td><td><a>E 4</a></td><td></td><td></td><td></td></tr></tbody></table></div>"""
    got = [tuple(r)[2:] for r in readers.histories(one(spark, history), "html", "https://s.example/").orderBy("position").collect()]
    assert got == [
        ("B One", "https://s.example/fighter/B-1", "E 2", "https://s.example/events/E-2", "2013-09-20", "win", "KO (Kick)", "Ref", 2, "4:33"),
        ("C Two", "", "E 3", "http://o.example/E", "", "draw", "", "", 0, ""),
    ]
    hrefs = {"/a": "https://s.example/a", "b/c?d": "https://s.example/b/c?d", "//h/x": "https://h/x", "HTTP://u/": "HTTP://u/", "mailto:x@y": "", "javascript:void();": "", "": "", None: ""}
    got = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", readers.resolved(F.col("h"), "https://s.example").alias("u")).collect()
    assert {r["h"]: r["u"] for r in got} == hrefs
    badges = {"final_result win": "win", "final_result loss": "loss", "final_result draw": "draw", "final_result no_contest": "nc", "cancelled": "not_finished", "yet_to_come": "not_finished", "Final_Result NC": "not_finished"}
    got = spark.createDataFrame([(b,) for b in badges], "b string").select("b", readers.result_of(F.col("b")).alias("r")).collect()
    assert {r["b"]: r["r"] for r in got} == badges
