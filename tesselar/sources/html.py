"""Sections of accordion pages, tolerant of unclosed tags."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(["p", "ul", "ol", "blockquote", "h2", "h3"])
CLOSES_P = frozenset("p div ul ol blockquote table pre h1 h2 h3 h4 h5 h6 section article".split())
HOLDS = frozenset("div td th li section article blockquote root".split())
SCHEMA = "array<struct<title:string,heading:string,main_content:string,notes:array<struct<heading:string,content:string>>,subsections:array<struct<heading:string,content:string>>,links:array<struct<text:string,url:string>>>>"


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if not (isinstance(c, Node) and c.tag in ("script", "style")))

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:  # a block ends the paragraph that is open, with the marks in it
            node = self.at
            while node.parent is not None and node.tag not in HOLDS:
                if node.tag == "p":
                    self.at = node.parent
                    break
                node = node.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _tidy(node: Node) -> str:
    return " ".join(node.text().split())


def _inside(node: Node, name: str) -> bool:
    while node.parent is not None:
        node = node.parent
        if name in node.classes():
            return True
    return False


def _after_h4(node: Node) -> bool:
    """Whether the nearest heading before the element among its siblings is an h4."""
    siblings = node.parent.elements()
    for s in reversed(siblings[: next(i for i, x in enumerate(siblings) if x is node)]):
        if s.tag == "h4":
            return True
        if s.tag in ("h2", "h3"):
            return False
    return False


def main_text(node: Node, without: str | None = "note") -> str:
    """Paragraphs, lists, quotes and headings outside notes and subsections, parted by empty lines."""
    parts = [_tidy(n) for n in node.walk() if n.tag in BLOCKS and not (without and _inside(n, without)) and not _after_h4(n)]
    return "\n\n".join(p for p in parts if p)


def notes(node: Node) -> list[dict]:
    out = []
    for n in node.walk():
        if n.tag == "div" and "note" in n.classes():
            heading = next((x for x in n.walk() if x.tag == "h3"), None)
            out.append({"heading": _tidy(heading) if heading else "", "content": main_text(n, None)})
    return out


def subsections(node: Node) -> list[dict]:
    out = []
    for h in (n for n in node.walk() if n.tag == "h4"):
        siblings = h.parent.elements()
        parts = []
        for s in siblings[next(i for i, x in enumerate(siblings) if x is h) + 1 :]:
            if s.tag in ("h2", "h3", "h4"):
                break
            if s.tag in ("p", "ul", "ol") and _tidy(s):
                parts.append(_tidy(s))
        if parts:
            out.append({"heading": _tidy(h), "content": "\n\n".join(parts)})
    return out


def links(node: Node) -> list[dict]:
    return [{"text": _tidy(n), "url": n.attrs["href"]} for n in node.walk() if n.tag == "a" and (n.attrs.get("href") or "#")[:1] != "#"]


def sections(html: str) -> list[dict]:
    """The accordion's sections, those with contacts left out."""
    out = []
    for item in parse(html).walk():
        if item.tag != "div" or "page-nav-accordion__item" not in item.classes():
            continue
        title = next((n for n in item.walk() if n.tag == "a" and "page-nav-accordion__title" in n.classes()), None)
        content = next((n for n in item.walk() if n.tag == "div" and "page-nav-accordion__content" in n.classes()), None)
        if title is None or content is None or _tidy(title).lower() in ("key contacts", "contacts"):
            continue
        h1 = next((n for n in content.walk() if n.tag == "h1"), None)
        out.append({"title": _tidy(title), "heading": _tidy(h1) if h1 else _tidy(title), "main_content": main_text(content), "notes": notes(content), "subsections": subsections(content), "links": links(content)})
    return out


def html_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, section) for each section of each page."""
    from pyspark.sql import functions as F

    @F.pandas_udf(SCHEMA)
    def parsed(column):
        return column.map(lambda h: sections(h) if h else [])

    return pages.select(key, F.explode(parsed(html)).alias("section"))


def html_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text): the main text of each page or fragment."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def parsed(column):
        return column.map(lambda h: main_text(parse(h)) if h else "")

    return pages.select(key, parsed(html).alias("text"))
