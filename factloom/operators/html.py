"""HTML pages as documents (IO4 to IO6, IO8, F11, F12, S33 to S36).

Parsing is a function of the row: one Arrow function over the standard library's parser gives body, metadata, links, tables
and ordered blocks; status, acceptability and quality are expressions over its result. PDF parsing and browser rendering lie
outside the engine; pages that would need them get a status.
"""

from __future__ import annotations

import itertools
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import vectorized, with_rows

from ..functions import text as X

# Element names and patterns whose exact form decides results.
DROPPED = {"script", "style", "nav", "footer", "aside", "form", "noscript", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
TEXT_BLOCKS = {"h1", "h2", "h3", "p", "li", "blockquote", "pre"}
STRUCTURE = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre", "table"}
_HIDDEN = re.compile(r"display:\s?none")
_SPEAKER = re.compile(r"^([A-Z][\w .'-]{0,79}):\s+(.+)$")

BLOCKS = "array<struct<kind: string, text: string, heading_path: array<string>, position: string, paragraph_index: int, speaker: string, table_ref: string, column_labels: array<string>, quote_citation: string>>"
DOCUMENT = f"struct<body: string, precise: string, title: string, author: string, publisher: string, published_at: string, updated_at: string, headings: array<string>, tables: array<string>, quotes: array<string>, corrections: array<string>, links: array<string>, hidden: int, malformed_tables: int, blocks: {BLOCKS}>"


class Node:
    __slots__ = ("name", "attrs", "children", "parent", "known")

    def __init__(self, name, attrs=(), parent=None):
        self.name, self.attrs, self.children, self.parent, self.known = name, dict(attrs), [], parent, None

    def all(self, names=None):
        """Elements below, in document order, without dropped ones."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            if n.name in DROPPED:
                continue
            if names is None or n.name in names:
                yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def outermost(self, names):
        """Elements of these names below, in document order, without those inside another of them."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            if n.name in names:
                yield n
            elif n.name not in DROPPED:
                stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        if self.known is not None:
            return self.known
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if t := n.strip():
                    parts.append(t)
            elif n.name not in DROPPED:
                stack += list(reversed(n.children))
        self.known = tidy(" ".join(parts))
        return self.known


class Tree(HTMLParser):
    """A tree of elements and texts; comments and declarations go. An end tag closes up to its element, if one is open."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root")
        self.nodes = []
        self.feed(html)
        self.close()
        # only parsing needs a node's parent; without it, a page's tree goes with its root
        for n in self.nodes:
            n.parent = None

    def handle_starttag(self, tag, attrs):
        node = self._added(tag, attrs)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self._added(tag, attrs)

    def _added(self, tag, attrs) -> Node:
        node = Node(tag, attrs, self.now)
        self.now.children.append(node)
        self.nodes.append(node)
        return node

    def handle_endtag(self, tag):
        n = self.now
        while n is not None and n.name != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.now = n.parent

    def handle_data(self, data):
        self.now.children.append(data)


def tidy(text: str) -> str:
    return "\n".join(re.sub(r"[ \t\r\f\v]+", " ", line).strip() for line in text.splitlines() if line.strip())


def _cells(row: Node) -> list[str]:
    return [c.text() for c in row.all({"th", "td"})]


def _entries(root: Node):
    """The structure of a page, flat: (kind, place, text, note); place: the level of a heading, table and row of a row; note: a row's
    column labels, a quote's address."""
    tables = itertools.count(1)
    for node in root.outermost(STRUCTURE):
        if node.name == "table":
            t, rows = next(tables), [_cells(r) for r in node.all({"tr"})]
            for i, cells in enumerate(rows, 1):
                if any(cells):
                    named = i > 1 and rows[0] and len(rows[0]) == len(cells)
                    yield "table_row", (t, i), " | ".join(f"{h}: {v}" if h else v for h, v in zip(rows[0], cells, strict=True)) if named else " | ".join(cells), rows[0]
        elif text := node.text():
            level = node.name[1:] if node.name[0] == "h" else ""
            quote = node.name == "blockquote"
            yield ("heading", int(level), text, None) if level.isdigit() else ("quote" if quote else "paragraph", None, text, (node.attrs.get("cite") or None) if quote else None)


def structured_blocks(root: Node) -> list[dict]:
    """IO6: headings with their path, table rows named by their header, turns, quotes and paragraphs."""
    out, path, paragraphs = [], {}, itertools.count(1)
    for kind, place, text, note in _entries(root):
        block = {"kind": kind, "text": text, "paragraph_index": None, "speaker": None, "table_ref": None, "column_labels": None, "quote_citation": None}
        if kind == "heading":
            path = {level: t for level, t in path.items() if level < place} | {place: text}
            block["position"] = f"heading {len(out) + 1}"
        elif kind == "table_row":
            block |= {"position": f"table {place[0]}, row {place[1]}", "table_ref": f"table {place[0]} row {place[1]}", "column_labels": note}
        else:
            turn = _SPEAKER.match(text)
            n = next(paragraphs)
            block |= {"kind": "transcript_turn" if turn else kind, "position": f"paragraph {n}", "paragraph_index": n, "speaker": turn[1] if turn else None, "quote_citation": note}
        out.append(block | {"heading_path": list(path.values())})
    return out


#: What the precision parser goes by: elements whose text is a part of the sentence around them, elements that hold others together,
#: elements that are no content wherever they stand, and words in the class, id or role of such.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HOLDERS = {"article", "body", "center", "details", "div", "fieldset", "html", "main", "section"}
SENTENCE_ENDS = (".", "!", "?", ":", ";", "\u2026", '"', "\u201d", "\u00bb")
NO_CONTENT = DROPPED | {"button", "dialog", "embed", "head", "iframe", "input", "menu", "object", "select", "textarea", "title"}
_BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|menu|nav|navigation|newsletter|pager|pagination|popup|promo\w*|recommend\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|tags?|toolbar|widget)(?:$|[\s_-])", re.I)


def _runs(root: Node) -> tuple[list[tuple[str, int, int, str]], list[int]]:
    """Text runs of a page in document order: (text, characters of it in links, the closest holder's number, whether a heading, a row
    or text); and each holder's own holder, numbered in document order, the page itself 0. A run ends where an element that isn't inline begins or ends; a row's cells are one run. Elements without content
    are left out."""
    runs, texts, links, now, outer = [], [], 0, (0, "text"), [0]

    def end():
        nonlocal texts, links
        if text := " ".join(texts):
            runs.append((text, min(links, len(text)), *now))
        texts, links = [], 0

    stack = [(c, 0, False, "text") for c in reversed(root.children)]
    while stack:
        n, holder, linked, kind = stack.pop()
        if n is None:  # an element's end
            end()
        elif isinstance(n, str):
            if part := " ".join(n.split()):
                now = (holder, kind)
                texts.append(part)
                links += len(part) if linked else 0
        elif n.name not in NO_CONTENT and not ("hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or _HIDDEN.search(n.attrs.get("style") or "")):
            if n.name not in ("html", "body", "main", "article") and any(_BOILERPLATE.search(n.attrs.get(a) or "") for a in ("class", "id", "role")):
                continue
            if n.name in ("td", "th"):
                if texts:
                    texts.append("|")
            elif n.name not in INLINE:
                end()
                if n.name in HOLDERS:
                    outer.append(holder)
                    holder = len(outer) - 1
                stack.append((None, holder, linked, kind))
            if len(n.name) == 2 and n.name[0] == "h" and n.name[1].isdigit():
                kind = "heading"
            elif n.name == "tr":
                kind = "row"
            stack += [(c, holder, linked or n.name == "a", kind) for c in reversed(n.children)]
    end()
    return runs, outer


def precise_text(root: Node) -> str | None:
    """IO4: a page's main text by the density of texts and links, the precision view; null where nothing is dense enough.

    A run is dense if at most a third of its characters lie in links and it is a heading, a row of several cells, has 40 characters
    or ends like a sentence. A dense run that isn't a heading weighs its characters outside links, less those inside; any other one
    takes away its characters in links. The sums over all that a holder holds give the main part: from the holder of the largest
    sum, down to the innermost one that still has nine tenths of it. Its dense runs follow in order, each once; headings only
    before another dense run."""
    runs, outer = _runs(root)
    sums, last, depth, dense = [0] * len(outer), list(range(len(outer))), [0] * len(outer), []
    for text, linked, holder, kind in runs:
        good = 3 * linked <= len(text) and (kind == "heading" or (kind == "row" and " | " in text) or len(text) >= 40 or text.endswith(SENTENCE_ENDS))
        dense.append(good)
        sums[holder] += 0 if good and kind == "heading" else len(text) - 2 * linked if good else -linked
    for h in range(len(outer) - 1, 0, -1):  # inner holders have higher numbers
        sums[outer[h]] += sums[h]
        last[outer[h]] = max(last[outer[h]], last[h])
    for h in range(1, len(outer)):
        depth[h] = depth[outer[h]] + 1
    most = max(sums)
    if most <= 0:
        return None
    main = max((h for h in range(len(outer)) if 10 * sums[h] >= 9 * most), key=lambda h: (depth[h], sums[h], -h))
    out, headings = {}, []
    for (text, _, holder, kind), good in zip(runs, dense, strict=True):
        if good and main <= holder <= last[main]:
            if kind == "heading":
                headings.append(text)
            else:
                out |= dict.fromkeys([*headings, text])
                headings = []
    return "\n\n".join(out) or None


def _written(top: list[Node], meta: dict) -> tuple[str | None, str | None]:
    """Author and date of a page that has no such meta elements: by its links' relation, item properties and time elements."""
    author = next((t for n in top if (n.attrs.get("rel") == "author" or n.attrs.get("itemprop") == "author") and (t := n.text())), None)
    date = next((n.attrs["datetime"] for n in top if n.name == "time" and n.attrs.get("datetime")), None)
    return meta.get("article:author") or author, meta.get("date") or meta.get("dc.date") or date


def parse_page(html: str | None, url: str | None) -> dict | None:
    """IO5: the article's, else the main part's, else the body's text; null without any of them. IO4: precise, the main text by
    density; its author and date where IO5 has none."""
    if html is None:
        return None
    tree = Tree(html).root
    top = list(tree.all())
    by_name = {}
    for n in top:
        by_name.setdefault(n.name, []).append(n)
    root = next((by_name[name][0] for name in ("article", "main", "body") if name in by_name), None)
    if root is None:
        return None
    meta = {}
    for m in by_name.get("meta", ()):
        for attr in ("property", "name"):
            if m.attrs.get(attr) and m.attrs.get("content"):
                meta.setdefault(m.attrs[attr], m.attrs["content"])
    below = list(root.all())
    of = lambda *names: [n for n in below if n.name in names]
    blocks = [t for n in below if n.name in TEXT_BLOCKS and (t := n.text())]
    tables = [[c for r in t.all({"tr"}) if (c := _cells(r))] for t in of("table")]
    links = [urljoin(url or "", a.attrs["href"]) for a in of("a") if a.attrs.get("href") and not a.attrs["href"].startswith(("#", "javascript:", "mailto:"))]
    rows = ["\n".join(" | ".join(c) for c in t) for t in tables]
    author, date = _written(top, meta)
    return {
        "body": "\n\n".join(dict.fromkeys(blocks)),
        "title": meta.get("og:title") or (by_name["title"][0].text() if "title" in by_name else None),
        "precise": precise_text(tree),
        "author": meta.get("author") or author,
        "publisher": meta.get("og:site_name"),
        "published_at": meta.get("article:published_time") or date,
        "updated_at": meta.get("article:modified_time"),
        "headings": [n.text() for n in of("h1", "h2", "h3")],
        "tables": [t for t in rows if t],
        "quotes": [n.text() for n in of("blockquote")],
        "corrections": [b for b in blocks if any(w in b.casefold() for w in ("correction", "retraction", "editor's note"))],
        "links": list(dict.fromkeys(links)),
        "hidden": sum("hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(n.attrs.get("style") or "")) for n in top),
        "malformed_tables": sum(len({len(c) for c in t}) > 1 for t in tables),
        "blocks": structured_blocks(root),
    }


@vectorized(DOCUMENT)
def html_document(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    fields = ["body", "precise", "title", "author", "publisher", "published_at", "updated_at", "headings", "tables", "quotes", "corrections", "links", "hidden", "malformed_tables", "blocks"]
    rows = [parse_page(h, u) or dict.fromkeys(fields) for h, u in zip(html, url, strict=True)]
    out = pd.DataFrame(rows, columns=fields)
    return out.astype({"hidden": "Int32", "malformed_tables": "Int32"})


def parsed(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages with doc, as html_document() gives it."""
    return with_rows(pages, "doc", DOCUMENT, parse_page, html, url)


def iso_timestamp(c: Column) -> Column:
    """DT1: ISO dates, without zone taken as UTC; null where invalid."""
    return F.try_to_timestamp(c)


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """IO8: pages with doc (the structural parse, its body the precise one where that is acceptable), quality and status."""
    p = parsed(pages, html, url).withColumn("precise", F.when(X.acceptable(F.col("doc.precise")), F.col("doc.precise")))
    p = p.withColumn("body", F.coalesce("precise", F.when(X.acceptable(F.col("doc.body")), F.col("doc.body")))).withColumn("lines", X.lines_of(F.col("body")))
    status = F.when(F.col("body").isNotNull(), "FETCHED").otherwise(F.coalesce(X.access_barrier(F.col(html)), F.lit("EXTRACTION_FAILED")))
    quality = X.extraction_assessment(F.col("body"), F.col("doc.title"), F.array().cast("array<string>"), X.extraction_quality(F.col("body"), lines=F.col("lines")), F.col("doc.malformed_tables"), F.col("lines"))
    return p.withColumn("status", status).withColumn("quality", F.when(F.col("body").isNotNull(), quality)).withColumn("parser", F.when(F.col("precise").isNotNull(), "precise").when(F.col("body").isNotNull(), "structural")).drop("precise", "lines")


#: Media types that are read, the most bytes of each kind, and first bytes of executables and archives.
HTML_TYPES, PDF_TYPES = ["text/html", "application/xhtml+xml", "text/plain"], ["application/pdf"]
MOST_HTML, MOST_PDF = 5_000_000, 25_000_000
SIGNATURES = ["4D5A", "7F454C46", "504B0304", "FEEDFACE", "CFFAEDFE", "2321"]


def access_status(code: Column, content_type: Column, body: Column, declared: Column) -> Column:
    """The status of a fetch from HTTP code, media type, body (binary) and the declared length (text or null)."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    pdf, head = kind.isin(PDF_TYPES), F.hex(F.substring(body, 1, 5))
    most, size = F.when(pdf, MOST_PDF).otherwise(MOST_HTML), F.octet_length(body)
    said = declared.try_cast("long")
    bad_length = (F.coalesce(declared, F.lit("")) != "") & (said.isNull() | (said < 0) | (said > most))
    signed = F.lit(False)
    for x in SIGNATURES:
        signed = signed | F.startswith(head, F.lit(x))
    nul = F.rlike(F.hex(F.substring(body, 1, 4096)), F.lit("^(?:..)*?00"))
    unsupported = ~kind.isin(*HTML_TYPES, *PDF_TYPES) | bad_length | (size > most) | (~pdf & nul) | (pdf & (head != "255044462D")) | signed
    return F.when(code == 403, "BOT_BLOCKED").when(code.isin(401, 402), "PAYWALLED").when(code >= 400, "INACCESSIBLE").when(F.coalesce(unsupported, F.lit(True)), "UNSUPPORTED").otherwise("FETCHED")
