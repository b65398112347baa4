"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. Blocks inside parts that are
never main text (navigation, footers, asides, forms, scripts, and elements
whose class, id or role names such a part) are boilerplate. The rest is judged
in two passes:

1. By link density, length and stop-word density: mostly links is boilerplate;
   long with enough stop words is main text; short is ambiguous; else the
   density decides. Inside an ``article`` or ``main`` element only a block of
   mostly links is boilerplate, and no block there is ambiguous for its words.
2. Ambiguous blocks take the label of the nearest decided block (the later one
   of two that are equally near, as headings belong to what follows); if no
   block is decided, they stay in.

If a page marks its article, blocks outside of it are boilerplate.

Character references are decoded, white space inside a block is one space,
blocks are joined in page order by a line feed. Comments and raw text elements
run to their end tag, or to the end of a page that breaks off; an unfinished
tag at the end is markup.

Defined cases: null and empty pages, and pages without main text, give an
empty text; rows that repeat an id get a result each; markup may be wrong or
unclosed in any way.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspin.llm import common as C

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
MARKS = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot
thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("nav footer aside form head button select option svg template dialog menu object canvas math datalist label".split())
NAMES = set("""ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation
menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer footers masthead toolbar topbar comment comments commentlist
respond reply replies disqus discussion notice notices cookie cookies consent gdpr popup modal overlay alert subscribe subscription newsletter
signup login share sharing social related recommended pagination pager copyright disclaimer skip search searchform form""".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Names of wrappers that only say what stands next to them.
BESIDE = {"no", "with", "has", "without", "not"}
STOP_WORDS = set("""the of and to in a is that it for on was with as are be this by from or an not have at which you he they but his her
le la les de des du un une et en est que qui dans pour sur au aux avec par pas ce se il elle sont plus ne
der die das und ist von zu den mit auf für im dem ein eine einer nicht sich des als auch es an werden aus er hat dass sie
el los las y del al un una que es por con para se su lo como no más o sus""".split())
WORD = re.compile(r"[^\W\d_]+")
LINKS, LONG, SHORT, DENSE, THIN = 0.5, 140, 70, 0.25, 0.12


class _Open:
    __slots__ = ("tag", "never", "inside", "link")

    def __init__(self, tag: str, never: bool, inside: bool, link: bool):
        self.tag, self.never, self.inside, self.link = tag, never, inside, link


def _named_away(tag: str, attributes: str) -> tuple[bool, bool]:
    """(is it a part that is never main text, does it mark the article) by its attributes."""
    away = inside = False
    for m in MARKS.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            away = True
        elif name == "role":
            away |= value in ROLES
            inside |= value in ("main", "article")
        elif name == "itemprop":
            inside |= value == "articlebody"
        elif name in ("class", "id"):
            for part in value.split():
                words = re.findall(r"[a-z]+", part)
                away |= bool(words) and words[0] not in BESIDE and not NAMES.isdisjoint(words)
    if tag in ("html", "body", "main"):
        away = False
    return away, inside


def blocks_of(html: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters inside links, never main text, inside an article) of
    the blocks of a page, in order; empty blocks are left out."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack = [_Open("", False, False, False)]

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, len(" ".join(unescape("".join(linked)).split())), stack[-1].never, stack[-1].inside))
            parts.clear()
            linked.clear()

    def take(text: str) -> None:
        if text:
            parts.append(text)
            if stack[-1].link:
                linked.append(text)

    opened: dict[str, list[int]] = {}  # places of each tag on the stack, so that a search looks at none of the others

    def shut(tag: str, until: tuple[str, ...] = ()) -> None:
        """Close the innermost ``tag``, unless one of ``until`` is open inside it."""
        k = opened[tag][-1] if opened.get(tag) else 0
        if k and not any(opened[u][-1] > k for u in until if opened.get(u)):
            while len(stack) > k:
                opened[stack.pop().tag].pop()

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            take(html[at:])
            break
        take(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        block = tag in BLOCK
        if m[1]:
            if block:
                close()
            if tag == "br" or tag in ("td", "th"):
                take(" ")
            if tag in ("html", "body"):
                continue
            shut(tag, ("td", "table") if tag in ("p", "li", "b", "i", "a", "span") else ())
            continue
        if block:
            close()
            shut("p", ("td", "div", "section", "article", "main", "table", "li"))
            if tag == "li":
                shut("li", ("ul", "ol", "menu"))
            elif tag in ("dt", "dd"):
                shut("dt", ("dl",))
                shut("dd", ("dl",))
            elif tag == "tr":
                shut("tr", ("table",))
        if tag in ("br", "td", "th", "img", "wbr") and tag != "wbr":
            take(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if m[3].rstrip().endswith("/") and not block and tag not in ("a", "b", "i", "span"):
            continue
        top = stack[-1]
        away, inside = _named_away(tag, m[3])
        marks = tag in ("article", "main") or inside
        if tag == "body":
            shut("head")
            top = stack[-1]
        never = top.never or away or tag in NEVER or tag == "header" and not top.inside
        if marks and not away:  # an article ends a part that was left open
            never = False
        opened.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, never, (top.inside or marks) and not never, top.link or tag == "a"))
    close()
    return out


def label_blocks(blocks: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """Is each block main text? First pass by its own features, second pass by
    the nearest decided blocks."""
    marked = any(inside for _, _, _, inside in blocks)
    labels: list[bool | None] = []
    for text, linked, never, inside in blocks:
        if never or marked and not inside:
            labels.append(False)
            continue
        words = WORD.findall(text.lower())
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        mostly_links = linked > LINKS * len(text)
        if inside:
            labels.append(None if mostly_links and len(text) < SHORT else not mostly_links)
        elif mostly_links:
            labels.append(False)
        elif len(text) < SHORT:
            labels.append(None)
        elif len(text) >= LONG and density >= DENSE:
            labels.append(True)
        else:
            labels.append(True if density >= DENSE else None if density >= THIN else False)
    # distance to the nearest decided block before and after; structure decides nothing about neighbours outside it
    decided = [label is not None and not never for label, (_, _, never, _) in zip(labels, blocks)]
    out = [bool(x) for x in labels]
    before: list[int | None] = []
    last = None
    for i, d in enumerate(decided):
        last = i if d else last
        before.append(last)
    last = None
    for i in range(len(blocks) - 1, -1, -1):
        last = i if decided[i] else last
        if labels[i] is None:
            b, a = before[i], last
            if b is None and a is None:
                out[i] = True
            elif a is None or b is not None and i - b < a - i:
                out[i] = bool(labels[b])
            else:
                out[i] = bool(labels[a])
    return out


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    return "\n".join(b[0] for b, keep in zip(blocks, label_blocks(blocks)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: the id, the url, text and n_chars (code points)."""
    base = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))

    def run(batches):
        for rows, data, off in C.text_pieces(batches, "__html", 4 << 20):
            raw = data.tobytes()
            texts = [main_text(raw[off[i]:off[i + 1]].decode("utf-8", "replace")) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column("__id"), rows.column("__url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["__id", "__url", "text", "n_chars"])

    return base.mapInArrow(run, "__id long, __url string, text string, n_chars long").withColumnRenamed("__id", id_col).withColumnRenamed("__url", url_col)
