"""Pages as trees: elements are found by tag, class and place, not by patterns over the text of the page.

The parser reads tags, attributes and character references in one pass and keeps the open elements: void
elements close at once, a tag that can't stand inside an open one closes it (a new ``li`` ends the last), and an end tag
closes what was left open inside its element; one without an open element is passed over. It runs in Arrow batches, a
page at a time, in time and memory that grow with the page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Elements without content, those whose start ends others that are open, what such an end doesn't reach
# through, elements whose text is not shown, and those that stand on lines of their own.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}} | {b: {"p"} for b in _BLOCKS}
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}} | {t: {"table"} for t in ("tr", "td", "th", "tbody", "tfoot")}
HIDDEN = frozenset(("script", "style", "template", "noscript", "head"))
LINES = frozenset([*_BLOCKS, "li", "tr", "dt", "dd", "br"])


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)
    place: int = 0

    def walk(self) -> Iterator[Node]:
        """The elements inside, in page order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def pieces(self, shown: bool = False) -> Iterator[str]:
        """Texts inside in page order; ``shown`` leaves out what a browser doesn't show, and breaks lines at blocks."""
        todo: list = [*reversed(self.children)]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield re.sub(r"\s+", " ", n) if shown else n
            elif not (shown and n.tag in HIDDEN):
                if shown and n.tag in LINES:
                    yield "\n"
                    todo.append("\n")
                elif shown and n.tag in ("td", "th"):
                    todo.append("\t")
                todo += reversed(n.children)

    def text(self) -> str:
        return "".join(self.pieces())

    def shown(self) -> str:
        """The text as a browser shows it: white space in a line is one blank, blocks are lines, no line is empty."""
        lines = (" ".join(x.split()) for x in "".join(self.pieces(shown=True)).split("\n"))
        return "\n".join(x for x in lines if x)

    def next(self) -> Node | None:
        """The element right after this one in the same parent."""
        beside = self.parent.children if self.parent else []
        return next((beside[k] for k in range(self.place + 1, len(beside)) if isinstance(beside[k], Node)), None)

    def has(self, step: tuple[str, tuple[str, ...]]) -> bool:
        tag, classes = step
        return (not tag or self.tag == tag) and all(c in self.attrs.get("class", "").split() for c in classes)

    def select(self, selector: str) -> list[Node]:
        """Elements inside, in page order, by steps of tag and classes; a blank is any depth, > a child."""
        steps, direct = [], []
        for part in selector.replace(">", " > ").split():
            if part == ">":
                direct[-1:] = [True]
                continue
            tag, *classes = part.split(".")
            steps.append((tag, tuple(classes)))
            direct.append(False)

        # Which steps a node ends, from those its parent and all above end: one walk, whatever the depth.
        found, todo = [], [(c, 0, 0) for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n, parent, above = todo.pop()
            own = sum(1 << k for k, step in enumerate(steps) if n.has(step) and (k == 0 or (parent if direct[k - 1] else above) >> (k - 1) & 1))
            if own >> (len(steps) - 1) & 1:
                found.append(n)
            todo += [(c, own, above | own) for c in reversed(n.children) if isinstance(c, Node)]
        return found

    def first(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)


_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR, _BARE, _BLANK = re.compile(r"=?[^\s/>=]*"), re.compile(r"[^\s>]*"), re.compile(r"[\s/]*")
#: Elements whose content is text up to their own end tag; in the second kind references are decoded.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title")}


class _Builder:
    """The tree so far, its open elements, and where each tag is among them; no step looks through all that are open."""

    def __init__(self):
        self.root = Node("")
        self.open, self.at = [self.root], {}

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.at[self.open.pop().tag].pop()

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        ends = ENDS.get(tag, ())
        if ends:
            wall = max((self.at[w][-1] for w in WALLS.get(tag, ("table", "td", "th", "button")) if self.at.get(w)), default=0)
            inside = [self.at[t][k] for t in ends if t in self.at for k in (bisect_right(self.at[t], wall),) if k < len(self.at[t])]
            if inside:
                self.close_from(min(inside))
        node = Node(tag, attrs, self.open[-1], place=len(self.open[-1].children))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def end(self, tag: str) -> None:
        if self.at.get(tag):
            self.close_from(self.at[tag][-1])

    def text(self, data: str) -> None:
        if data:
            self.open[-1].children.append(data)


def parse(page: str) -> Node:
    """The tree of a page. Every scan starts where the last one ended, or gives the rest of the page up: the time is linear."""
    b, pos, n = _Builder(), 0, len(page)
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            b.text(unescape(page[pos:]))
            break
        b.text(unescape(page[pos:lt]))
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            pos = n if stop < 0 else stop + 3
        elif page[lt + 1 : lt + 2] in ("!", "?") or (page.startswith("</", lt) and not _NAME.match(page, lt + 2)):
            stop = page.find(">", lt)
            pos = n if stop < 0 else stop + 1
        elif page.startswith("</", lt):
            stop = page.find(">", lt)
            if stop >= 0:
                b.end(_NAME.match(page, lt + 2)[0].lower())
            pos = n if stop < 0 else stop + 1
        elif (m := _NAME.match(page, lt + 1)) is None:
            b.text("<")
            pos = lt + 1
        else:
            pos, attrs = m.end(), {}
            while True:
                pos = _BLANK.match(page, pos).end()
                if pos >= n or page[pos] == ">":
                    break
                a = _ATTR.match(page, pos)
                pos, value = _BLANK.match(page, a.end()).end(), ""
                if page.startswith("=", pos):
                    pos = _BLANK.match(page, pos + 1).end()
                    if page[pos : pos + 1] in ("'", '"') and pos < n:
                        stop = page.find(page[pos], pos + 1)
                        value, pos = page[pos + 1 : stop if stop >= 0 else n], stop + 1 if stop >= 0 else n
                    else:
                        v = _BARE.match(page, pos)
                        value, pos = v[0], v.end()
                attrs.setdefault(a[0].lower(), unescape(value))
            if pos < n:
                tag = m[0].lower()
                b.start(tag, attrs)
                pos += 1
                if tag in _RAW:
                    end = _RAW[tag].search(page, pos)
                    stop = end.start() if end else n
                    b.text(page[pos:stop] if tag in ("script", "style") else unescape(page[pos:stop]))
                    pos = stop
                    if end is None:
                        break
    return b.root


def extract(pages: DataFrame, html: str, schema: str, of: Callable[[Node], list[tuple]]) -> DataFrame:
    """The columns of ``pages`` but ``html``, and of each page the rows ``of`` gives from its tree; null pages are empty."""
    added, kept = StructType.fromDDL(schema), pages.drop(html)
    out = StructType([*kept.schema.fields, *added.fields])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, rows = [], []
            for k, page in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = of(parse(page or ""))
                place += [k] * len(found)
                rows += found
            before = batch.take(pa.array(place, pa.int64()))
            values = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*before.columns[:-1], *values], out.names)

    return pages.select(*kept.columns, html).mapInArrow(run, out)


def labelled(text: str, label: str) -> str:
    return re.sub(rf"^{label}\s*", "", text.strip())


def faq_items(root: Node, item: str = "ul.faq_list > li", question: str = "a.faq_q", answer: str = "div.faq_a") -> list[tuple]:
    """(question, answer, sub_category) of the items of a list; those without a question go."""
    out = []
    for li in root.select(item):
        q, a = li.first(question), li.first(answer)
        if q is not None and q.text():
            asked = labelled(q.text(), "질문")
            found = re.match(r"^\[([^\]]+)\]", asked)
            out.append((asked, " ".join(labelled(a.shown(), "답변").split()) if a is not None else "", found[1] if found else ""))
    return out


def listed(root: Node, row: str = ".tableDefault table tbody tr") -> list[tuple]:
    """(category, title, num, row_num, pdf_url) of table rows with two cells or more and a link in the second."""
    out = []
    for tr in root.select(row):
        cells = tr.select("td")
        link = cells[1].first("a") if len(cells) > 1 else None
        if link is not None:
            view = re.search(r"doView\(\s*'([^']*)'\s*,\s*'([^']*)'\s*\)", link.attrs.get("onclick") or link.attrs.get("href", ""))
            pdf = cells[2].first("a") if len(cells) > 2 else None
            file = re.search(r"doFile\(\s*'([^']*)'\s*\)", pdf.attrs.get("onclick", "")) if pdf is not None else None
            out.append((cells[0].text().strip(), link.text().strip(), *(view.groups() if view else ("", "")), file[1] if file else None))
    return out


def last_page(root: Node, links: str = ".pager a") -> int:
    """The largest page number of the paging links, by their text or their target; at least 1."""
    found = [1]
    for a in root.select(links):
        text = a.text().strip()
        found += [int(text)] if text.isdigit() else []
        found += [int(n) for n in re.findall(r"goPage\(['\"]?(\d+)['\"]?\)", a.attrs.get("href", "") + " " + a.attrs.get("onclick", ""))]
    return max(found)


def sections(root: Node, heading: str = "h2", follow: tuple[str, ...] = ("p", "ul", "ol", "div")) -> list[tuple]:
    """(title, content) of headings with text: the shown text of the element right after, if it is one of ``follow``."""
    out = []
    for h in root.select(heading):
        if h.text():
            n = h.next()
            out.append((h.text().strip(), n.shown() if n is not None and n.tag in follow else ""))
    return out
