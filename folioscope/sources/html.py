"""HTML pages to markdown with head, title and JSON-LD; markdown pages pass through.

The parser is a tree-free pass over tags, run as an Arrow function; a page that is cut off or malformed gives what it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.markdown import marks_of

#: Elements that are no content, and where content is looked for, best first.
NOISE_TAGS = {"script", "style", "noscript", "svg", "iframe", "nav", "header", "footer", "aside"}
NOISE_ROLES = {"navigation", "banner", "contentinfo"}
NOISE_CLASSES = {"sidebar", "toc", "breadcrumb", "breadcrumbs", "cookie-banner", "skip-link"}
CONTENT = ["main", "article", "[role=main]", "#content", ".content", "body"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "figure", "dl", "dd", "dt", "body"}
LEAST_TEXT = 200
HEADINGS = {f"h{i}" for i in range(1, 7)}
STARTS_BLOCK = BLOCKS | HEADINGS | {"pre", "li", "hr"}
ENDS_PARAGRAPH = BLOCKS | HEADINGS | {"pre", "hr"}
MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_", "code": "`", "del": "~~", "s": "~~"}
SPACES, BREAK = re.compile(r"\s+"), re.compile(r" *\n *")
#: Open elements that a tag ends when it starts.
CLOSES = {"li": {"p", "li"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}}


class Node:
    """An element. What is asked often is noted when it opens: whether it or an element around it is noise, and, with its descendants, whether there are blocks below it."""

    __slots__ = ("tag", "attributes", "parent", "children", "noise", "hidden", "blocky", "inline", "blocks")

    def __init__(self, tag: str, attributes: dict, parent: Node | None):
        self.tag, self.attributes, self.parent, self.children, self.blocky = tag, attributes, parent, [], False
        self.noise = tag in NOISE_TAGS or bool(attributes) and (attributes.get("role") in NOISE_ROLES or attributes.get("aria-hidden") == "true" or bool(NOISE_CLASSES & set((attributes.get("class") or "").split())))
        self.hidden = self.noise or parent is not None and parent.hidden
        if tag in STARTS_BLOCK:
            while parent and not parent.blocky:
                parent.blocky, parent = True, parent.parent

    def matches(self, selector: str) -> bool:
        if selector[0] not in "#.[":
            return self.tag == selector
        a = self.attributes
        return bool(a) and {"#": a.get("id") == selector[1:], ".": selector[1:] in (a.get("class") or "").split(), "[": a.get("role") == "main"}[selector[0]]

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif not node.noise:
                todo += reversed(node.children)
        return "".join(out)


class Tree(HTMLParser):
    """Open elements close with their parents; paragraphs and list items also by their successors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, {"p"} if tag in ENDS_PARAGRAPH else ())
        while self.at.tag in closes and self.at.parent:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def running(parts: list[Node | str]) -> str:
    """Running text of strings and of elements whose own is known."""
    return "".join([SPACES.sub(" ", c) if isinstance(c, str) else c.inline for c in parts])


def inline(node: Node) -> str:
    """An element as running text, from that of its children."""
    if node.noise:
        return ""
    if node.tag == "br":
        return "\n"
    if node.tag == "img":
        return f"![{node.attributes.get('alt', '')}]({node.attributes.get('src', '')})"
    inner = running(node.children)
    bare = inner.strip()
    if node.tag == "a" and node.attributes.get("href") and bare:
        return f"[{bare}]({node.attributes['href']})"
    return f"{MARKS[node.tag]}{bare}{MARKS[node.tag]}" if node.tag in MARKS and bare else inner


def blocks(node: Node) -> list[str]:
    """Blocks of an element from those of its children; running text between blocks is a block of its own."""
    if node.noise:
        return []
    if node.tag in HEADINGS:
        text = running(node.children).strip().replace("\n", " ")
        return [f"{'#' * int(node.tag[1])} {text}"] if text else []
    if node.tag == "pre":
        code = next((c for c in node.children if isinstance(c, Node) and c.tag == "code"), node)
        tag = re.search(r"lang(?:uage)?-([\w+-]+)", code.attributes.get("class", ""))
        return [f"```{tag[1] if tag else ''}\n{node.text().strip(chr(10))}\n```"]
    if node.tag == "hr":
        return ["---"]
    if node.tag in ("ul", "ol"):
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        marks = [f"{i}. " if node.tag == "ol" else "- " for i in range(1, len(items) + 1)]
        rows = [m + "\n".join(c.blocks).replace("\n", "\n" + " " * len(m)) for m, c in zip(marks, items)]
        return ["\n".join(rows)] if rows else []
    if node.tag == "table":
        rows = [[" ".join(c.blocks).replace("|", "\\|").replace("\n", " ") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        return ["\n".join(f"| {' | '.join(r)} |" for r in (rows[0], ["---"] * len(rows[0]), *rows[1:]))] if rows else []
    if not node.blocky:
        text = BREAK.sub("\n", running(node.children)).strip()
        return [text] if text else []
    out, run = [], []

    def flush() -> None:
        text = running(run).strip()
        if text:
            out.append(text)
        run.clear()

    for child in node.children:
        if isinstance(child, Node) and (child.tag in STARTS_BLOCK or child.blocky):
            flush()
            out.extend(child.blocks)
        else:
            run.append(child)
    flush()
    return ["\n".join("> " + line for line in "\n\n".join(out).split("\n"))] if node.tag == "blockquote" and out else out


def markdown(main: Node) -> list[str]:
    """Blocks of an element nested to any depth: the inner elements first, so that no call waits for another. Elements with blocks are running text in headings only."""
    nodes, headed = [], set()
    for node in main.walk():
        nodes.append(node)
        if node.tag in HEADINGS or node.parent in headed:
            headed.add(node)
    for node in reversed(nodes):
        if not node.blocky or node.parent in headed:
            node.inline = inline(node)
        if node is main or node.blocky or node.tag in STARTS_BLOCK or node.tag in ("td", "th"):
            node.blocks = blocks(node)
    return main.blocks


def extract(url: str, html: str) -> dict:
    """One page: title, head lines (title, canonical, named metas), JSON-LD texts, markdown of the main content."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    nodes = list(tree.root.walk())
    raw = lambda n: "".join(c for c in n.children if isinstance(c, str))
    title = next((raw(n).strip() for n in nodes if n.tag == "title"), "")
    head = [f"<title>{title}</title>"] if title else []
    head += [f'<link rel="canonical" href="{n.attributes["href"]}">' for n in nodes if n.tag == "link" and n.attributes.get("rel") == "canonical" and n.attributes.get("href")][:1]
    for n in nodes:
        if n.tag == "meta":
            name = "name" if n.attributes.get("name") else "property"
            if n.attributes.get(name) and n.attributes.get("content") and not re.match("viewport|theme-color|msapplication|generator", n.attributes[name]):
                head.append(f'<meta {name}="{n.attributes[name]}" content="{n.attributes["content"]}">')
    scripts = [t for n in nodes if n.tag == "script" and n.attributes.get("type") == "application/ld+json" and (t := raw(n).strip())]
    visible = [n for n in nodes if not n.hidden]
    main = next((n for s in CONTENT for n in [next((v for v in visible if v.matches(s)), None)] if n is not None and len(n.text().strip()) > LEAST_TEXT), None)
    main = main or next((n for n in nodes if n.tag == "body"), tree.root)
    first = next((n.text().strip() for n in main.walk() if n.tag == "h1"), "")
    return {"format": "html", "title": title or first or url, "head_html": "\n".join(head) or None, "json_ld": scripts, "markdown": "\n\n".join(markdown(main)).strip()}


def read_pages(pages: DataFrame, url: str = "url", body: str = "html", marks: bool = False) -> DataFrame:
    """(url, format, title, head_html, json_ld, markdown) of raw pages. URLs ending in .md hold markdown already. Null bodies are empty pages.
    With `marks` also those of the markdown's lines, which `page_facts` would mark in a pass of its own.
    """
    names = ["url", "format", "title", "head_html", "json_ld", "markdown"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for address, text in zip(part["url"], part["body"]):
                if re.search(r"\.md(?:[?#]|$)", address or ""):
                    first = re.search(r"(?m)^#\s+(.+)$", text or "")
                    rows.append({"format": "markdown", "title": first[1].strip() if first else address, "head_html": None, "json_ld": [], "markdown": text or ""})
                else:
                    rows.append(extract(address or "", text or ""))
            out = pd.DataFrame(rows, columns=names[1:]).assign(url=part["url"].values)
            yield out.assign(marks=out["markdown"].map(marks_of))[[*names, "marks"]] if marks else out[names]

    shaped = pages.select(F.col(url).alias("url"), F.col(body).alias("body"))
    return shaped.mapInPandas(run, "url string, format string, title string, head_html string, json_ld array<string>, markdown string" + (", marks array<int>" if marks else ""))
