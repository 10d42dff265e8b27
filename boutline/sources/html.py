"""HTML pages read by rules: a tree builder, a selector matcher, and `extract`, which gives a row for each match with the fields it holds.

`extract` parses each page once, in Arrow batches, and only the fields asked for leave the worker; what they mean (dates, numbers, addresses, results) is left to built-in
expressions over the rows.

The tree builder is a state machine over tags.  Void elements have no content; a start tag ends the elements that it implies the end of (a paragraph before a block,
an item, cell, row or section before the next) within the nearest list or table; rows and cells get the sections and rows that they leave out; an end
tag that nothing matches is dropped, and one that matches further up ends what is open in between, but not across a table's cell.  Script, style, title and
textarea hold text alone.  What browsers mend beyond that (formatting reopened in the next block, text moved out of tables) is left as it is written.

Nodes are numbered in document order, and a node's descendants are those after it up to its `last`, so that "inside" is a comparison of numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pages whose rows a worker holds at once.
PAGES = 64

# Elements without content; elements that hold text alone (True: with character references); blocks that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = {"script": False, "style": False, "title": True, "textarea": True}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# For a start tag the elements that it ends, and those that shield what is outside them.
_CELLS, _SECTIONS = frozenset(["td", "th"]), frozenset(["thead", "tbody", "tfoot"])
_TABLE = frozenset(["table"])
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "table"]) | _CELLS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"]) | _CELLS),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"]) | _CELLS),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "table": (_TABLE, _CELLS | {"caption"}),
    **{c: (_CELLS | {"caption"}, _TABLE) for c in _CELLS},
    "tr": (_CELLS | {"tr", "caption"}, _TABLE),
    **{s: (_CELLS | _SECTIONS | {"tr", "caption", "colgroup"}, _TABLE) for s in _SECTIONS},
}
_PARAGRAPH = (frozenset(["p"]), frozenset(["table", "caption", "button"]) | _CELLS)
_TABLE_PARTS = _CELLS | _SECTIONS | {"table", "tr", "caption"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A tag as most are written: attributes behind white space, values that are quoted or hold no quotes.  Others are read attribute by attribute.
_PLAIN = re.compile(r"</?[a-zA-Z][^\s/>\"'=<]*(?:\s+[^\s\"'<>/=]+(?:=(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Plain tags read before, by their text, which pages repeat: tag, attributes, and the keys under which a node is found.  At most TAGS of them, of at most TAG characters.
_READ: dict[str, tuple[str, dict[str, str], tuple[str, ...]]] = {}
TAGS, TAG = 4096, 256
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)|(?=>)))?")


def _keys(tag: str, attrs: dict[str, str]) -> tuple[str, ...]:
    """A node's tag, .class, #id and [attribute."""
    if not attrs:
        return (tag,)
    return tuple({tag, *(f"[{a}" for a in attrs), *(f".{c}" for c in attrs.get("class", "").split()), *([f"#{attrs['id']}"] if "id" in attrs else [])})


def _attributes(markup: str, at: int) -> tuple[dict[str, str], int]:
    """A tag's attributes from `at` on, and where it ends."""
    attrs, n = {}, len(markup)
    while at < n and markup[at] != ">":
        found = _ATTRIBUTE.match(markup, at)
        if not found or found.end() == at:
            at += 1
            continue
        value = next((v for v in found.groups()[1:] if v is not None), "")
        attrs.setdefault(found[1].lower(), unescape(value))
        at = found.end()
    return attrs, at


def _plain_tag(text: str) -> tuple[str, dict[str, str], tuple[str, ...]]:
    name = _NAME.match(text, 2 if text[1] == "/" else 1)
    tag, attrs = name[0].lower(), _attributes(text, name.end())[0]
    read = (tag, attrs, _keys(tag, attrs))
    if len(text) <= TAG:
        if len(_READ) >= TAGS:
            _READ.clear()
        _READ[text] = read
    return read


class Tree:
    """The nodes of one page: parallel lists in document order.  Attributes may be shared between nodes."""

    def __init__(self, markup: str):
        self.last: list[int] = []
        self.tags: list[str] = []
        self.attrs: list[dict[str, str] | None] = []
        self.texts: list[str | None] = []
        self.keys: list[tuple[str, ...]] = []
        self.written: dict[int, str] = {}  # the source of a title's or textarea's text where references change it
        self.index: defaultdict[str, list[int]] = defaultdict(list)  # nodes by tag, .class, #id and [attribute
        self.open: list[int] = []
        self.n_open: defaultdict[str, int] = defaultdict(int)
        self.found: dict[tuple[str, int | None], list[int]] = {}
        at, n = 0, len(markup)
        find, plain = markup.find, _PLAIN.match
        while at < n:
            tag = find("<", at)
            if tag < 0:
                tag = n
            if tag > at:
                self._text(unescape(markup[at:tag]))
                if tag == n:
                    break
            found = plain(markup, tag)
            if found:
                text, at = found[0], found.end()
                read = _READ.get(text) or _plain_tag(text)
                if text[1] == "/":
                    self._end(read[0])
                else:
                    self._start(*read)
                    if read[0] in RAW:
                        at = self._raw(markup, read[0], at)
            else:
                at = self._tag(markup, tag)
        self._close(0)

    def _node(self, tag: str, attrs: dict[str, str] | None, text: str | None, keys: tuple[str, ...]) -> int:
        node = len(self.last)
        self.last.append(node)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.texts.append(text)
        self.keys.append(keys)
        index = self.index
        for key in keys:
            index[key].append(node)
        return node

    def _text(self, text: str) -> None:
        if text:
            self._node("#text", None, text, ())

    def _raw(self, markup: str, tag: str, at: int) -> int:
        """The text that an element holds alone; where to go on."""
        end = _RAW_END[tag].search(markup, at)
        stop = end.start() if end else len(markup)
        source = markup[at:stop]
        text = unescape(source) if RAW[tag] else source
        if text != source:
            self.written[len(self.last)] = source
        self._text(text)
        return stop

    def _close(self, depth: int) -> None:
        """End the open elements from `depth` on."""
        at = len(self.last) - 1
        for node in self.open[depth:]:
            self.last[node] = at
            self.n_open[self.tags[node]] -= 1
        del self.open[depth:]

    def _end_implied(self, ends: frozenset, shields: frozenset) -> None:
        n_open = self.n_open
        for tag in ends:
            if n_open[tag]:
                break
        else:
            return
        found = None
        tags, nodes = self.tags, self.open
        for depth in range(len(nodes) - 1, -1, -1):
            tag = tags[nodes[depth]]
            if tag in ends:
                found = depth
            elif tag in shields:
                break
        if found is not None:
            self._close(found)

    def _tag(self, markup: str, at: int) -> int:
        """Read what begins with `<` at `at`; where to go on."""
        n = len(markup)
        if markup.startswith("<!--", at):
            end = markup.find("-->", at + 4)
            return n if end < 0 else end + 3
        ends = markup.startswith("</", at)
        name = _NAME.match(markup, at + 1 + ends)
        if not name:
            if ends or markup[at + 1 : at + 2] in ("!", "?"):  # declarations and bogus comments
                end = markup.find(">", at)
                return n if end < 0 else end + 1
            self._text("<")
            return at + 1
        tag = name[0].lower()
        attrs, at = _attributes(markup, name.end())
        if at >= n:
            return n  # the page ends inside a tag, which is then none
        at += 1
        if ends:
            self._end(tag)
            return at
        self._start(tag, attrs, _keys(tag, attrs))
        return self._raw(markup, tag, at) if tag in RAW else at

    def _start(self, tag: str, attrs: dict[str, str], keys: tuple[str, ...]) -> None:
        implied = IMPLIED.get(tag)
        if implied:
            self._end_implied(*implied)
        if tag in BLOCKS:
            self._end_implied(*_PARAGRAPH)
        if tag == "tr" or tag in _CELLS:
            top = self.tags[self.open[-1]] if self.open else ""
            if top == "table":
                self._start("tbody", {}, ("tbody",))
                top = "tbody"
            if tag != "tr" and top in _SECTIONS:
                self._start("tr", {}, ("tr",))
        node = self._node(tag, attrs, None, keys)
        if tag not in VOID:
            self.open.append(node)
            self.n_open[tag] += 1

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._start("br", {}, ("br",))
            return
        if not self.n_open[tag]:
            return
        tags, nodes = self.tags, self.open
        for depth in range(len(nodes) - 1, -1, -1):
            here = tags[nodes[depth]]
            if here == tag:
                self._close(depth)
                return
            if here == "table" or here in _TABLE_PARTS and tag not in _TABLE_PARTS:
                return

    def classes(self, node: int) -> list[str]:
        return self.attrs[node].get("class", "").split()

    def find(self, selector: str, within: int | None = None) -> list[int]:
        """The nodes that match, in document order: compounds joined by spaces (inside) and lists of such by commas.  `within`: only among the descendants of
        that node, the outer compounds included."""
        at = (selector, within)
        if at not in self.found:
            self.found[at] = self._find(selector, within)
        return self.found[at]

    def _find(self, selector: str, within: int | None) -> list[int]:
        low, high = (0, len(self.last) - 1) if within is None else (within + 1, self.last[within])
        levels = []
        for chain in compiled(selector):
            level = self._matching(chain[0], low, high)
            for compound in chain[1:]:
                inside, end = [], -1
                for outer in level:  # an outer node inside the last one adds nothing
                    if outer > end:
                        end = self.last[outer]
                        inside += self._matching(compound, outer + 1, end)
                level = inside
            levels.append(level)
        return levels[0] if len(levels) == 1 else sorted(set().union(*levels))

    def _matching(self, compound: Compound, low: int, high: int) -> list[int]:
        if compound.keys:
            some = min([self.index.get(key, []) for key in compound.keys], key=len)
        else:
            some = [k for k in range(low, high + 1) if self.attrs[k] is not None]
        some = some[bisect_left(some, low) : bisect_right(some, high)]
        return some if compound.alone else [k for k in some if compound.test(self, k)]

    def text(self, node: int, without: str | None = None, breaks: bool = False, written: bool = False) -> str:
        """The text inside a node, white space collapsed and trimmed.  `without`: what is inside matching nodes is left out; `breaks`: a line break counts as a
        space; `written`: a title's or textarea's character references stay as they are written."""
        texts, end = self.texts, self.last[node] + 1
        if not (without or breaks or written):
            return " ".join("".join([x for x in texts[node + 1 : end] if x is not None]).split())
        gone = [(k, self.last[k]) for k in self.find(without, node)] if without else []
        parts = []
        for k in range(node + 1, end):
            if texts[k] is not None:
                if not any(a < k <= b for a, b in gone):
                    parts.append(self.written.get(k, texts[k]) if written else texts[k])
            elif breaks and self.tags[k] == "br":
                parts.append(" ")
        return " ".join("".join(parts).split())

    def parent(self, node: int) -> int | None:
        return next((k for k in range(node - 1, -1, -1) if self.texts[k] is None and self.last[k] >= node), None)


# ---- selectors

_PART = re.compile(r"(:not\()?(?:([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([\^*~$]?=)\"([^\"]*)\")?\])(\))?")
_TESTS: dict[str, Callable[[str, str], bool]] = {"=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__, "~=": lambda own, value: value in own.split()}


@dataclass(frozen=True)
class Compound:
    """Tests of one node: `keys` of the index that must hold it, `others` that must not, and attribute tests (name, how, value)."""

    keys: tuple[str, ...]
    others: tuple[str, ...]
    tests: tuple[tuple[str, str, str], ...]

    @cached_property
    def alone(self) -> bool:
        """One key of the index is all there is to it."""
        return len(self.keys) == 1 and not self.others and not self.tests

    def test(self, tree: Tree, node: int) -> bool:
        own, attrs = tree.keys[node], tree.attrs[node]
        return all(k in own for k in self.keys) and not any(k in own for k in self.others) and all(_TESTS[how](attrs[name], value) for name, how, value in self.tests)


@lru_cache(maxsize=1024)
def compiled(selector: str) -> tuple[tuple[Compound, ...], ...]:
    """A selector's chains of compounds: tag, .class, #id, [name], [name="v"] (also ^=, $=, *= and ~=) one after another, and :not(..) of one of the first four."""
    return tuple(tuple(_compound(part) for part in chain.split() or [""]) for chain in re.split(r",(?![^\[]*\])", selector))


def _compound(part: str) -> Compound:
    keys, others, tests, at = [], [], [], 0
    for found in _PART.finditer(part):
        if found.start() != at:
            break
        negated, tag, cls, ident, name, how, value, closed = found.groups()
        if bool(negated) != bool(closed) or negated and how:
            break
        at = found.end()
        (others if negated else keys).append(tag.lower() if tag else f".{cls}" if cls else f"#{ident}" if ident else f"[{name}")
        if how:
            tests.append((name, how, value))
    if at != len(part) or not part:
        raise ValueError(f"not a selector: {part!r}")
    return Compound(tuple(keys), tuple(others), tuple(tests))


# ---- rows

@dataclass(frozen=True)
class Field:
    """What a row takes: `path` leads from the row's node by (selector, which match from 0, negative from the end); "/" before a selector begins at the page, and ".." goes
    to the parent.  The value is the text there, or the attribute `attr`; with `every`, the values of all matches of the last step; with `count`, their number;
    `written`: see `Tree.text`."""

    path: tuple[tuple[str, int], ...] = ()
    attr: str | None = None
    without: str | None = None
    breaks: bool = False
    every: bool = False
    count: bool = False
    written: bool = False

    @property
    def kind(self) -> T.DataType:
        return T.ArrayType(T.StringType()) if self.every else T.IntegerType() if self.count else T.StringType()

    def of(self, tree: Tree, node: int | None) -> str | int | list | None:
        last = len(self.path) - 1
        for at, (selector, nth) in enumerate(self.path):
            if selector == "..":
                node = tree.parent(node)
            else:
                matches = tree.find(selector.removeprefix("/"), None if selector[0] == "/" else node)
                if at == last and self.count:
                    return len(matches)
                if at == last and self.every:
                    return [self._value(tree, k) for k in matches]
                node = matches[nth] if -len(matches) <= nth < len(matches) else None
            if node is None:
                return 0 if self.count else [] if self.every else None
        return None if node is None else self._value(tree, node)

    def _value(self, tree: Tree, node: int) -> str | None:
        return tree.attrs[node].get(self.attr) if self.attr else tree.text(node, self.without, self.breaks, self.written)


@dataclass(frozen=True)
class Rows:
    """A row for each node that matches `selector` (None: one for the page), or for the first alone, with its fields."""

    selector: str | None
    fields: dict[str, Field]
    first: bool = False


def extract(df: DataFrame, html: str, rules: dict[str, Rows]) -> DataFrame:
    """`df` without its column `html`, with `rule` (the name of the rule), `position` (from 0, within page and rule) and the rules' fields, which are the same in each.

    Null and empty pages give the rows of rules without a selector, all null; so does any markup that lacks what a field asks for.  Repeated rows
    each give their rows; a column with the name of a field, `rule` or `position` is replaced."""
    fields = next(iter(rules.values())).fields
    if any({n: f.kind for n, f in r.fields.items()} != {n: f.kind for n, f in fields.items()} for r in rules.values()):
        raise ValueError("the rules must have the same fields")
    new = {"rule": T.StringType(), "position": T.IntegerType(), **{n: f.kind for n, f in fields.items()}}
    kept = [f for f in df.schema.fields if f.name != html and f.name not in new]
    shape = T.StructType(kept + [T.StructField(n, t) for n, t in new.items()])
    kinds = {n: pa.list_(pa.string()) if isinstance(t, T.ArrayType) else pa.int32() if isinstance(t, T.IntegerType) else pa.string() for n, t in new.items()}

    def rows_of(markup: str) -> Iterator[tuple]:
        tree = Tree(markup)
        for name, rule in rules.items():
            found = [None] if rule.selector is None else tree.find(rule.selector)
            for position, node in enumerate(found[:1] if rule.first else found):
                yield (name, position, *(f.of(tree, node) for f in rule.fields.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAGES):
                batch = whole.slice(start, PAGES)
                made = [list(rows_of(markup or "")) for markup in batch.column(batch.schema.get_field_index(html)).to_pylist()]
                at = pa.array([k for k, rows in enumerate(made) for _ in rows], pa.int32())
                columns = [batch.column(batch.schema.get_field_index(f.name)).take(at) for f in kept]
                values = list(zip(*(row for rows in made for row in rows))) or [()] * len(kinds)
                columns += [pa.array(v, kind) for v, kind in zip(values, kinds.values())]
                yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    return df.mapInArrow(run, shape)
