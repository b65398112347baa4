"""Pages as flat arrays, for native column work, and CSS selectors over them.

``page_arrays`` reads each page once with the standard library's tokenizer and
returns one row per page: the text nodes in order, and the elements in order
with the ranges that they span (``n`` to ``last`` among the elements, ``s`` to
``e`` among the text nodes). An element lies inside another one if its number
lies in the other's range, so no element lists what is around it, and all arrays
are linear in the page, whatever the nesting. The length and the sentence marks of
an element's text are differences of running sums over the nodes.

Selectors: tags, ``*``, .class, #id, [name] with = ~= ^= $= *= |=, :first-of-type and
:first-child, joined by blanks (inside) or ``>`` (child), groups by commas. Any
other raises an error. All selectors of a page are matched in one walk: an
element takes over what its parent's line has matched, and looks only at the parts
that name its own tag, classes, id or attributes.

Rules: void tags close at once; an end tag closes the nearest open element of
its name, and is ignored when none is open; unclosed ``<p>`` nest; comments and
the text of scripts and styles are no text.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ELEMENT = ("struct<n:int,last:int,tag:string,parent:string,attrs:map<string,string>,classes:array<string>,"
           "s:int,e:int,size:int,marks:int,hidden:boolean>")
#: What a rule found: ``value`` is an attribute's, or null where the element's text counts.
HIT = "struct<field:string,pos:int,n:int,tag:string,parent:string,classes:array<string>,s:int,e:int,size:int,marks:int,value:string,lo:int,hi:int>"
SCHEMA = f"page_id long, url string, html_length int, nodes array<string>, shown array<string>, elements array<{ELEMENT}>, hits array<{HIT}>, errors array<string>"
_SPAN = [("s", pa.int32()), ("e", pa.int32()), ("size", pa.int32()), ("marks", pa.int32())]
ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("html_length", pa.int32()), ("nodes", pa.list_(pa.string())), ("shown", pa.list_(pa.string())),
    ("elements", pa.list_(pa.struct([
        ("n", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("parent", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
        ("classes", pa.list_(pa.string())), *_SPAN, ("hidden", pa.bool_())]))),
    ("hits", pa.list_(pa.struct([
        ("field", pa.string()), ("pos", pa.int32()), ("n", pa.int32()), ("tag", pa.string()), ("parent", pa.string()), ("classes", pa.list_(pa.string())), *_SPAN,
        ("value", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))),
    ("errors", pa.list_(pa.string()))])
MARK = re.compile("[.?!] ")
#: Characters of pages after which their arrays are handed on.
OUT_CHARS = 256 << 10

# -- selectors -------------------------------------------------------------------------

PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[^\s.\#\[\]:>,+~]+)|\#(?P<id>[^\s.\#\[\]:>,+~]+)|:(?P<first>first-of-type|first-child)
    |\[\s*(?P<name>[^\s=~^$*|\]]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:'(?P<a>[^']*)'|"(?P<b>[^"]*)"|(?P<c>[^\]\s'"]+))\s*)?\]""", re.X)
GROUPS = re.compile(r"\s*,(?![^\[]*\])\s*")
JOINT = re.compile(r"\s*(?P<comma>,)\s*|\s*(?P<child>>)\s*|(?P<inside>\s+)")
TESTS = {None: lambda have, want: True, "=": lambda have, want: have == want, "~=": lambda have, want: want in have.split(),
         "^=": lambda have, want: want != "" and have.startswith(want), "$=": lambda have, want: want != "" and have.endswith(want),
         "*=": lambda have, want: want != "" and want in have, "|=": lambda have, want: have == want or have.startswith(want + "-")}


#: The test that an element must meet first, so that few selectors are looked at.
RARITY = ("id", "class", "attr", "tag", "first")


def parse_selector(text: str) -> list[list[tuple[str, list[tuple]]]]:
    """Groups of (how it joins the part before, tests) of a selector; a
    ValueError for what is not understood."""
    text, at = text.strip(), 0
    groups: list = [[("", [])]]
    while at < len(text):
        m = PART.match(text, at)
        if m and not (m["tag"] and groups[-1][-1][1]):  # a tag comes first
            tests = groups[-1][-1][1]
            if m["tag"]:
                tests.append(("tag", m["tag"].lower()))
            elif m["cls"] or m["id"]:
                tests.append(("class", m["cls"]) if m["cls"] else ("id", m["id"]))
            elif m["first"]:
                tests.append(("first", m["first"]))
            else:
                tests.append(("attr", m["name"].lower(), m["op"], next((m[k] for k in "abc" if m[k] is not None), "")))
        else:
            m = JOINT.match(text, at)
            if not m or not groups[-1][-1][1]:
                raise ValueError(f"selector not understood at place {at}: {text}")
            if m["comma"]:
                groups.append([("", [])])
            else:
                groups[-1].append((">" if m["child"] else " ", []))
        at = m.end()
    if not groups[-1][-1][1]:
        raise ValueError(f"selector not understood at its end: {text}")
    return groups


@functools.lru_cache(10_000)
def inside(selector: str, around: str | None) -> str:
    """The selector, met inside what ``around`` selects."""
    if not around:
        return selector
    return ", ".join(f"{a} {s}" for a in GROUPS.split(around) for s in GROUPS.split(selector))


class Selectors:
    """Some selectors, ready to be matched together."""

    def __init__(self, texts):
        self.by_key: dict[str, list[int]] = {}
        self.parts: list[tuple] = []  # (tests, joint, part before, selector that ends here or -1)
        for k, text in enumerate(texts):
            for group in parse_selector(text):
                before = -1
                for i, (joint, tests) in enumerate(group):
                    self.parts.append((tests, joint, before, k if i == len(group) - 1 else -1))
                    before = len(self.parts) - 1
                    rare = min(tests, key=lambda t: RARITY.index(t[0]))
                    key = "*" if rare[0] == "first" or rare[1] == "*" else f"{rare[0]} {rare[1]}"
                    self.by_key.setdefault(key, []).append(before)
        self.size = len(texts)

    def match(self, page: FlatPage, gone: bytearray) -> list[list[int]]:
        """Elements of each selector, in the page's order."""
        found: list[list[int]] = [[] for _ in range(self.size)]
        exact, around = [0] * (len(page.tags) + 1), [0] * (len(page.tags) + 1)  # the last place is the page itself
        of_type, child = set(), set()
        get, parts = self.by_key.get, self.parts
        for i, tag in enumerate(page.tags):
            if gone[i]:
                continue
            up, attrs = page.parent[i], page.attrs[i]
            first = ("first-of-type" if (up, tag) not in of_type else "", "first-child" if up not in child else "")
            of_type.add((up, tag))
            child.add(up)
            above = around[i] = around[up] | exact[up]
            keys = ["*", "tag " + tag, *["attr " + k for k in attrs]]
            classes = attrs["class"].split() if "class" in attrs else ()
            keys += ["class " + c for c in classes]
            if "id" in attrs:
                keys.append("id " + attrs["id"])
            for key in keys:
                for j in get(key, ()):
                    tests, joint, before, ends = parts[j]
                    if before >= 0 and not (exact[up] if joint == ">" else above) >> before & 1 or exact[i] >> j & 1:
                        continue
                    if all(t[1] in ("*", tag) if t[0] == "tag" else t[1] in classes if t[0] == "class" else attrs.get("id") == t[1] if t[0] == "id"
                           else t[1] in first if t[0] == "first" else t[1] in attrs and TESTS[t[2]](attrs[t[1]], t[3]) for t in tests):
                        exact[i] |= 1 << j
                        if ends >= 0 and (not found[ends] or found[ends][-1] != i):
                            found[ends].append(i)
        return found


_SELECTORS: dict[tuple, Selectors] = {}


def selectors(texts: tuple) -> Selectors:
    if texts not in _SELECTORS:
        if len(_SELECTORS) > 10_000:
            _SELECTORS.clear()
        _SELECTORS[texts] = Selectors(texts)
    return _SELECTORS[texts]


class FlatPage(HTMLParser):
    """Elements and text nodes of one page in document order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict] = []
        self.parent: list[int] = []
        self.span: list[list[int]] = []  # last element, first text, text behind
        self.texts: list[str] = []
        self.owner: list[int] = []
        self.open: list[int] = []
        self.names: Counter = Counter()
        self.errors: list[str] = []
        try:
            self.feed(html)
            self.close()
        except Exception as problem:  # noqa: BLE001 - what was read stays, and the row says so
            self.errors.append(f"Page reading stopped: {problem}")
        while self.open:
            self._shut()

    def _shut(self) -> None:
        i = self.open.pop()
        self.names[self.tags[i]] -= 1
        self.span[i][0], self.span[i][2] = len(self.tags) - 1, len(self.texts)

    def handle_starttag(self, tag, attrs):
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.parent.append(self.open[-1] if self.open else -1)
        self.span.append([i, len(self.texts), len(self.texts)])
        if tag not in VOID:
            self.open.append(i)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut()

    def handle_endtag(self, tag):
        if self.names[tag] > 0:
            while self.tags[self.open[-1]] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        at = self.open[-1] if self.open else -1
        if at < 0 or self.tags[at] not in ("script", "style"):
            self.texts.append(data)
            self.owner.append(at)

    # -- what is left after removals -------------------------------------------------
    def without(self, tags=(), class_words=(), id_words=(), least_text: dict | None = None) -> bytearray:
        """Marks of removed elements: the given tags, classes that contain a
        word, per id word the first element left, and then elements of a tag
        whose text is shorter than ``least_text`` of it."""
        gone = bytearray(len(self.tags))

        def drop(i):
            gone[i:self.span[i][0] + 1] = b"\1" * (self.span[i][0] + 1 - i)

        word = re.compile("|".join(map(re.escape, class_words)), re.I) if class_words else None
        for i, tag in enumerate(self.tags):
            if not gone[i] and (tag in tags or word and word.search(self.attrs[i].get("class", ""))):
                drop(i)
        named = [i for i, a in enumerate(self.attrs) if "id" in a]
        for w in id_words:
            first = next((i for i in named if not gone[i] and re.search(w, self.attrs[i]["id"], re.I)), None)
            if first is not None:
                drop(first)
        if least_text:
            total = [0]
            for text, at in zip(self.texts, self.owner):
                total.append(total[-1] + (len(text.strip()) if at < 0 or not gone[at] else 0))
            for i, tag in enumerate(self.tags):
                if not gone[i] and tag in least_text and total[self.span[i][2]] - total[self.span[i][1]] < least_text[tag]:
                    drop(i)
        return gone

    def rows(self, gone: bytearray, strip: bool, hidden_tags=()) -> tuple[list, list, list]:
        """(text nodes, the same with those inside hidden tags empty, elements)."""
        keep = [at < 0 or not gone[at] for at in self.owner]
        if strip:
            keep = [k and bool(t.strip()) for k, t in zip(keep, self.texts)]
        new_text, new_element = [0], [0]
        for k in keep:
            new_text.append(new_text[-1] + k)
        for g in gone:
            new_element.append(new_element[-1] + (not g))
        hidden = bytearray(len(self.tags) + 1)
        for i, tag in enumerate(self.tags):
            hidden[i] = tag in hidden_tags or self.parent[i] >= 0 and hidden[self.parent[i]]
        nodes = [t.strip() if strip else t for t, k in zip(self.texts, keep) if k]
        shown = ["" if at >= 0 and hidden[at] else t.strip() for t, at, k in zip(self.texts, self.owner, keep) if k]
        size, marks = [0], [0]
        for t in nodes:
            size.append(size[-1] + len(t))
            marks.append(marks[-1] + len(MARK.findall(t)))
        out, number = [], {}
        for i, tag in enumerate(self.tags):
            if gone[i]:
                continue
            a, up = self.attrs[i], self.parent[i]
            last, s, e = self.span[i]
            s, e = new_text[s], new_text[e]
            number[i] = len(out)
            out.append({"n": new_element[i], "last": new_element[last + 1] - 1, "tag": tag, "parent": self.tags[up] if up >= 0 else "", "attrs": list(a.items()),
                        "classes": a.get("class", "").split(), "s": s, "e": e, "size": size[e] - size[s], "marks": marks[e] - marks[s],
                        "hidden": up >= 0 and bool(hidden[up])})
        return nodes, shown, out, number


def rule_hits(page: FlatPage, gone: bytearray, rules: list[dict], elements: list[dict], number: dict) -> list[dict]:
    """What a page's rules found, in their order: the first element of each, or
    all where the rule says so."""
    found = selectors(tuple(inside(r["selector"], r["around"]) for r in rules)).match(page, gone)
    out = []
    for r, hits in zip(rules, found):
        for i in hits if r["every"] else hits[:1]:
            x, attrs = elements[number[i]], page.attrs[i]
            # the first of the rule's attributes that the element has; its text always counts
            name = next((a for a in r["attributes"] if a == "text" or a in attrs), "text")
            out.append({k: x[k] for k in ("n", "tag", "parent", "classes", "s", "e", "size", "marks")}
                       | {"field": r["field"], "pos": r["pos"], "lo": r["min_len"], "hi": r["max_len"], "value": None if name == "text" else attrs[name]})
    return out


def page_arrays(pages: DataFrame, id_col: str = "page_id", remove: dict | None = None, strip: bool = True, hidden_tags=(), rules=None,
                own_rules: str | None = None) -> DataFrame:
    """One row of arrays per page (SCHEMA). ``remove`` holds the arguments of
    ``FlatPage.without``; ``rules`` maps a host ("*": all) and a field to its rules,
    and the column ``own_rules`` holds further ones of the page's host."""
    def applied(host, own):
        """The rules of a page; those of its host replace a field's general ones."""
        scoped = {**(rules or {}).get("*", {}), **(rules or {}).get(host, {})}
        by_field: dict[str, list] = {}
        for r in own or ():
            by_field.setdefault(r["field"], []).append(r)
        return [r for rows in {**scoped, **by_field}.values() for r in rows]

    def run(batches):
        for b in batches:
            out, size = {f.name: [] for f in ARROW}, 0
            columns = [b.column(c) for c in ("page_id", "url", "html", "host", "own")]
            for i in range(b.num_rows):  # one page at a time: only its own strings are held
                pid, url, html, host, mine = (c[i].as_py() for c in columns)
                page = FlatPage(html or "")
                gone = page.without(**(remove or {}))
                nodes, shown, elements, number = page.rows(gone, strip, hidden_tags)
                asked = applied(host, mine)
                hits = rule_hits(page, gone, asked, elements, number) if asked else []
                for name, value in zip(ARROW.names, (pid, url, len(html or ""), nodes, shown, elements, hits, page.errors)):
                    out[name].append(value)
                size += len(html or "")
                if len(out["page_id"]) >= 64 or size >= OUT_CHARS:
                    yield pa.RecordBatch.from_pydict(out, schema=ARROW)
                    out, size = {f.name: [] for f in ARROW}, 0
            if out["page_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=ARROW)

    host = F.col("host") if "host" in pages.columns else F.lit(None).cast("string")
    own = F.col(own_rules) if own_rules else F.lit(None).cast(f"array<{RULE_ROW}>")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), "url", "html", host.alias("host"), own.alias("own")).mapInArrow(run, SCHEMA)


#: A rule as ``rule_hits`` takes it: ``selector`` may be any that parse_selector takes.
RULE_ROW = "struct<field:string,pos:int,selector:string,around:string,attributes:array<string>,min_len:int,max_len:int,every:boolean>"
