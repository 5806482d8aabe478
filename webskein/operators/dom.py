"""Extraction from a page's tree. Each page is parsed once, in an Arrow-batched function that returns one struct per page.

The parser is the standard library's, with implied ends for paragraphs, items, cells and options; void elements have no
children. strict=True keeps what existing data was made with: an img's src counts only where data-srcset is given.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import markup, urls
from ..session import sliced, spread

# Elements and selectors that aren't content, and video platforms.
REMOVED = ("script", "style", "noscript", "iframe", "embed", "object", "applet", "canvas", "svg")
BOILERPLATE_TAGS = ("nav", "header", "footer", "aside")
BOILERPLATE_ROLES = ("navigation", "banner", "contentinfo")
BOILERPLATE_CLASSES = ("nav", "navigation", "menu", "sidebar", "header", "footer", "advertisement", "ad", "social", "share", "related", "comments")
BOILERPLATE_IDS = ("nav", "navigation", "menu", "sidebar", "header", "footer", "comments")
VIDEO_PLATFORMS = (("youtube", r"youtube\.com/embed/|youtube\.com/watch|youtu\.be/|youtube-nocookie\.com/embed/"), ("vimeo", r"vimeo\.com/|player\.vimeo\.com/"), ("dailymotion", r"dailymotion\.com/"), ("wistia", r"wistia\.com/|wistia\.net/"))
ICON_RELS = ("icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed")
OTHER_META_SKIPPED = ("description", "author", "keywords", "robots", "viewport", "charset")
OTHER_META_PREFIXES = ("og:", "twitter:", "fb:", "article:")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("table td th ul ol div section article body html".split())


class Node:
    """An element (or, with tag "", a text) of the tree."""

    __slots__ = ("tag", "attrs", "children", "parent", "data")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: "Node | None" = None, data: str = ""):
        self.tag, self.attrs, self.parent, self.data = tag, attrs or {}, parent, data
        self.children: list[Node] = []

    def walk(self) -> Iterator["Node"]:
        """This node and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def find(self, *tags: str, where: Callable[["Node"], bool] = lambda n: True) -> list["Node"]:
        return [n for n in self.walk() if n.tag and n is not self and (not tags or n.tag in tags) and where(n)]

    def first(self, *tags: str, where: Callable[["Node"], bool] = lambda n: True) -> "Node | None":
        return next((n for n in self.walk() if n.tag and n is not self and (not tags or n.tag in tags) and where(n)), None)

    def get(self, name: str, other: str = "") -> str:
        return self.attrs.get(name, other)

    def texts(self) -> list[str]:
        return [t for n in self.walk() if not n.tag and (t := n.data.strip())]

    def text(self, joint: str = "") -> str:
        return joint.join(self.texts())

    def remove(self, wanted: Callable[["Node"], bool]) -> None:
        for n in list(self.walk()):
            if n.tag and n.parent is not None and wanted(n):
                n.parent.children = [c for c in n.parent.children if c is not n]

    def html(self) -> str:
        if not self.tag:
            return self.data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        inner = "".join(c.html() for c in self.children)
        if self.tag == "#root":
            return inner
        given = "".join(' {}="{}"'.format(k, v.replace("&", "&amp;").replace('"', "&quot;")) for k, v in self.attrs.items())
        return f"<{self.tag}{given}>" + ("" if self.tag in VOID else f"{inner}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _close(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in stop:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._close(("p",), SCOPES)
        for name in ENDS.get(tag, ()):
            self._close((name,), frozenset(("table", "ul", "ol", "dl", "select")) - {tag})
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        node = Node(tag, first, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.parent is not None:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(Node("", None, self.at, data))


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _has(attr: str, *values: str) -> Callable[[Node], bool]:
    return lambda n: n.get(attr) in values


def _meta(root: Node, name: str) -> str:
    for attr, value in (("name", name), ("name", name.capitalize()), ("property", name)):
        if found := root.first("meta", where=_has(attr, value)):
            return found.get("content").strip()
    return ""


def title(root: Node) -> str:
    found = root.first("title")
    if found and len(found.children) == 1 and not found.children[0].tag and found.children[0].data:
        return found.children[0].data.strip()
    og = root.first("meta", where=_has("property", "og:title"))
    if og and og.get("content"):
        return og.get("content").strip()
    h1 = root.first("h1")
    return h1.text() if h1 else ""


def metadata(root: Node) -> dict:
    """The page's metadata; names as in the result."""
    charset = root.first("meta", where=lambda n: "charset" in n.attrs)
    typed = root.first("meta", where=_has("http-equiv", "Content-Type"))
    declared = typed.get("content") if typed else ""
    html = root.first("html")
    language = html.get("lang").strip() if html else ""
    if not language and (m := root.first("meta", where=_has("http-equiv", "content-language"))):
        language = m.get("content").strip()
    icons = (root.first("link", where=_has("rel", rel)) or root.first("link", where=lambda n, rel=rel: rel in n.get("rel").lower()) for rel in ICON_RELS)
    canonical = root.first("link", where=lambda n: "canonical" in n.get("rel").split())
    named = root.find("meta", where=lambda n: "name" in n.attrs)
    other = {}
    for n in named:
        name, content = n.get("name").lower(), n.get("content").strip()
        if content and name not in OTHER_META_SKIPPED and not name.startswith(OTHER_META_PREFIXES):
            other[name] = content
    return {
        "title": title(root),
        "description": _meta(root, "description"),
        "author": _meta(root, "author"),
        "robots": _meta(root, "robots"),
        "keywords": [k.strip() for k in _meta(root, "keywords").split(",") if k.strip()],
        "charset": charset.get("charset") if charset else declared.split("charset=")[-1].strip() if "charset=" in declared else "utf-8",
        "canonical_url": canonical.get("href").strip() if canonical else "",
        "language": language,
        "favicon": next((i.get("href").strip() for i in icons if i and i.get("href")), ""),
        "og": {n.get("property")[3:]: n.get("content").strip() for n in root.find("meta", where=lambda n: n.get("property").startswith("og:"))},
        "twitter": {n.get("name")[8:]: n.get("content").strip() for n in named if n.get("name").startswith("twitter:")},
        "other_meta": other,
    }


def links(root: Node, base: str, include_subdomains: bool = True) -> list[dict]:
    """Distinct links in document order, normalised."""
    out: dict[str, dict] = {}
    for a in root.find("a", where=lambda n: "href" in n.attrs):
        href = a.get("href").strip()
        try:
            scheme = urlsplit(href).scheme.lower()
        except ValueError:
            continue
        if not href or href.startswith("#") or scheme in markup.SKIPPED_SCHEMES:
            continue
        url = urls.normalized(href, base)
        if url and url not in out:
            rel = a.get("rel").split()
            out[url] = {"url": url, "text": a.text()[:200], "title": a.get("title"), "rel": rel, "is_nofollow": "nofollow" in rel}
    host = lambda u: (urlsplit(u).hostname or "").lower()

    def registered(u: str) -> str:
        labels = host(u).split(".")
        return ".".join(labels[-3:] if ".".join(labels[-2:]) in urls.SUFFIXES else labels[-2:])

    own = registered if include_subdomains else host
    for link in out.values():
        link["is_internal"] = own(link["url"]) == own(base)
    return list(out.values())


def addresses(root: Node) -> list[str]:
    out = [t for n in root.find("address") if len(t := n.text()) > 10]
    for wanted in (lambda n: "PostalAddress" in n.get("itemtype"), lambda n: "address" in n.get("class"), lambda n: "address" in n.get("id")):
        for n in root.find(where=wanted):
            if len(t := n.text()) > 10 and t not in out:
                out.append(t)
    return out[:10]


def _dimension(value: str) -> int | None:
    try:
        return int(float(value.replace("px", "").strip()))
    except (ValueError, OverflowError):
        return None


def _extension(url: str) -> str:
    try:
        name = urlsplit(url).path.rstrip("/").rsplit("/", 1)[-1]
    except ValueError:
        return ""
    stem, dot, suffix = name.rpartition(".")
    return "." + suffix.lower() if dot and stem.strip(".") and suffix else ""


def images(root: Node, base: str, strict: bool = True) -> list[dict]:
    found: dict[str, dict] = {}

    def add(src: str, node: Node | None = None) -> None:
        full = urljoin(base, src) if base else src
        if full not in found:
            found[full] = {
                "url": full,
                "alt": node.get("alt").strip() if node else "",
                "title": node.get("title").strip() if node else "",
                "width": _dimension(node.get("width")) if node else None,
                "height": _dimension(node.get("height")) if node else None,
                "format": _extension(full).lstrip(".").upper(),
            }

    for img in root.find("img"):
        lazy = img.get("data-srcset")
        src = next((img.get(a) for a in ("src", "data-src", "data-lazy-src", "data-original") if img.get(a)), "")
        if not src and lazy.split(",")[0].split():
            src = lazy.split(",")[0].split()[0]
        if src and not src.startswith("data:") and (lazy or not strict):
            add(src, img)
    for source in (s for p in root.find("picture") for s in p.find("source")):
        if parts := source.get("srcset").split(",")[0].split():
            add(parts[0])
    for node in root.find(where=lambda n: "background-image" in n.get("style")):
        for src in re.findall(r"url\(['\"]?(.*?)['\"]?\)", node.get("style")):
            if not src.startswith("data:"):
                add(src)
    return list(found.values())


def videos(root: Node, base: str) -> list[dict]:
    found: dict[str, dict] = {}

    def add(src: str, kind: str, source: str, poster: str = "", name: str = "") -> None:
        full = urljoin(base, src) if base else src
        found.setdefault(full, {"url": full, "type": kind, "source": source, "poster": poster, "title": name})

    for video in root.find("video"):
        for src in [s.get("src") for s in video.find("source")] or [video.get("src")]:
            if src:
                add(src, "html5", "self-hosted", video.get("poster"))
    for frame in root.find("iframe"):
        src = frame.get("src") or frame.get("data-src")
        full = urljoin(base, src) if base and src else src
        platform = next((p for p, pattern in VIDEO_PLATFORMS if src and re.search(pattern, full, re.I)), None)
        if platform:
            add(src, "iframe", platform, name=frame.get("title"))
    for node in root.find("embed", "object"):
        src = node.get("src") or node.get("data")
        if src and _extension(urljoin(base, src) if base else src) in urls.VIDEOS:
            add(src, "embed", "self-hosted")
    return list(found.values())


def files(root: Node, base: str) -> list[dict]:
    out: dict[str, dict] = {}
    for a in root.find("a", where=lambda n: "href" in n.attrs):
        href = urljoin(base, a.get("href")) if base else a.get("href")
        ext = _extension(href)
        if ext in urls.DOWNLOADS and href not in out:
            out[href] = {"url": href, "file_type": urls.TYPES.get(ext, ext[1:].upper()), "file_size": None, "filename": urlsplit(href).path.split("/")[-1]}
    return list(out.values())


def json_ld(root: Node) -> list[dict]:
    out = []
    for script in root.find("script", where=_has("type", "application/ld+json")):
        try:
            data = json.loads(script.text())
        except ValueError:
            continue
        for item in data if isinstance(data, list) else [data]:
            if not isinstance(item, dict):
                break
            kind = item.get("@type", "Unknown")
            out.append({"format": "json-ld", "type": kind if isinstance(kind, str) else json.dumps(kind), "data": json.dumps(item, ensure_ascii=False)})
    return out


_VALUES = {"meta": "content", "a": "href", "link": "href", "img": "src"}


def microdata(root: Node) -> list[dict]:
    out = []
    for scope in root.find(where=lambda n: "itemscope" in n.attrs):
        values = {}
        for n in scope.find(where=lambda n: "itemprop" in n.attrs):
            value = n.get(_VALUES[n.tag]) if n.tag in _VALUES else n.get("datetime", n.text()) if n.tag == "time" else n.text()
            if n.get("itemprop") and value:
                values[n.get("itemprop")] = value
        kind = scope.get("itemtype")
        if values:
            out.append({"format": "microdata", "type": kind.split("/")[-1] if kind else "Unknown", "data": json.dumps({"@type": kind, **values}, ensure_ascii=False)})
    return out


def rdfa(root: Node) -> list[dict]:
    """typeof scopes with their properties (a simple reading of RDFa)."""
    out = []
    for scope in root.find(where=lambda n: bool(n.get("typeof"))):
        values = {n.get("property"): n.get("content") or n.get("href") or n.text() for n in scope.find(where=lambda n: bool(n.get("property")))}
        if values:
            out.append({"format": "rdfa", "type": scope.get("typeof"), "data": json.dumps({"@type": scope.get("typeof"), **values}, ensure_ascii=False)})
    return out


def is_boilerplate(n: Node) -> bool:
    return n.tag in BOILERPLATE_TAGS or n.get("role") in BOILERPLATE_ROLES or n.get("id") in BOILERPLATE_IDS or any(c in BOILERPLATE_CLASSES for c in n.get("class").split())


def main_content(root: Node) -> str:
    """The element whose own paragraphs have the most text, less what is in links, as HTML."""
    scores: dict[int, list] = {}
    for p in root.find("p", "pre", "td"):
        size = len(p.text(" ")) - 2 * sum(len(a.text(" ")) for a in p.find("a"))
        if p.parent is not None and size > 25:
            scores.setdefault(id(p.parent), [0.0, p.parent])[0] += 1 + min(3, size / 100) + p.text().count(",")
    best = max(scores.values(), key=lambda s: s[0], default=None)
    return best[1].html() if best else root.html()


def cleaned(html: str) -> dict:
    """cleaned_html, main_content and text of the page without boilerplate."""
    root = parse(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", html))
    root.remove(lambda n: n.tag in REMOVED)
    root.remove(is_boilerplate)
    main = main_content(root)
    for n in root.walk():
        if n.tag:
            n.attrs = {k: v for k, v in n.attrs.items() if k in ("href", "src", "alt", "title")}
    return {"cleaned_html": root.html(), "main_content": main, "text": " ".join(root.text(" ").split())}


def paragraphs(root: Node) -> list[str]:
    return [t for p in root.find("p") if len(t := p.text()) > 20]


def without_boilerplate(html: str) -> str:
    root = parse(html)
    root.remove(is_boilerplate)
    return root.html()


def plain_text(html: str) -> str:
    """All text but that of scripts and styles, navigation included."""
    root = parse(html)
    root.remove(lambda n: n.tag in ("script", "style", "noscript"))
    return root.text(" ")


def anchors(root: Node) -> list[str]:
    return [a.get("href") for a in root.find("a", where=lambda n: "href" in n.attrs)]


_MAP = pa.map_(pa.string(), pa.string())
_STRINGS = pa.list_(pa.string())
_LINK = pa.struct([("url", pa.string()), ("text", pa.string()), ("title", pa.string()), ("rel", _STRINGS), ("is_nofollow", pa.bool_()), ("is_internal", pa.bool_())])
_IMAGE = pa.struct([("url", pa.string()), ("alt", pa.string()), ("title", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("format", pa.string())])
_VIDEO = pa.struct([(n, pa.string()) for n in ("url", "type", "source", "poster", "title")])
_FILE = pa.struct([("url", pa.string()), ("file_type", pa.string()), ("file_size", pa.int64()), ("filename", pa.string())])
_ITEM = pa.struct([("format", pa.string()), ("type", pa.string()), ("data", pa.string())])
_FIELDS = {
    "title": pa.string(), "description": pa.string(), "author": pa.string(), "robots": pa.string(), "keywords": _STRINGS, "charset": pa.string(), "canonical_url": pa.string(), "language": pa.string(),
    "favicon": pa.string(), "og": _MAP, "twitter": _MAP, "other_meta": _MAP, "links": pa.list_(_LINK), "addresses": _STRINGS, "hrefs": _STRINGS, "images": pa.list_(_IMAGE), "videos": pa.list_(_VIDEO),
    "files": pa.list_(_FILE), "structured": pa.list_(_ITEM), "cleaned_html": pa.string(), "main_content": pa.string(), "text": pa.string(), "plain_text": pa.string(), "paragraphs": _STRINGS,
}


_METADATA = frozenset("title description author robots keywords charset canonical_url language favicon og twitter other_meta".split())
_CLEANED = frozenset(("cleaned_html", "main_content", "text"))
#: Bytes of pages that are read before their trees go: a tree takes many times its page.
AT_ONCE = 1 << 20


def page_parts(html: str, url: str, strict: bool = True, fields: tuple[str, ...] | None = None) -> dict:
    """Everything, or at least the named fields, that is extracted from one page; what isn't asked for isn't made."""
    named = set(fields or _FIELDS)
    out: dict = {}
    if named - _CLEANED - {"plain_text"}:
        root = parse(html)
        if named & _METADATA:
            out |= metadata(root)
        each = {
            "links": lambda: links(root, url), "addresses": lambda: addresses(root), "hrefs": lambda: anchors(root), "images": lambda: images(root, url, strict), "videos": lambda: videos(root, url),
            "files": lambda: files(root, url), "structured": lambda: json_ld(root) + microdata(root) + rdfa(root), "paragraphs": lambda: paragraphs(root),
        }
        out |= {n: make() for n, make in each.items() if n in named}
    if "plain_text" in named:
        out["plain_text"] = plain_text(html)
    return out | cleaned(html) if named & _CLEANED else out


def extracted(pages: DataFrame, *, fields: tuple[str, ...] | None = None, strict: bool = True, keep_html: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """url and the fields of page_parts (all, or those named) for every page, its html if it is to be kept, and the columns in keep; null html and url count as empty."""
    from pyspark.sql.pandas.types import from_arrow_type

    names = list(fields or _FIELDS)
    kept = ["url", *(["html"] if keep_html else []), *keep]
    schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in kept) + ", " + ", ".join(f"{n} {from_arrow_type(_FIELDS[n]).simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_map = lambda n, v: list(v.items()) if _FIELDS[n] is _MAP else v
        for b in sliced(batches, "html", AT_ONCE):
            given = zip(b.column("html").to_pylist(), b.column("url").to_pylist(), strict=True)
            made = {n: [] for n in names}
            for h, u in given:
                parts = page_parts(h or "", u or "", strict, fields)
                for n in names:
                    made[n].append(as_map(n, parts[n]))
            out = pa.RecordBatch.from_arrays([*map(b.column, kept), *(pa.array(made[n], _FIELDS[n]) for n in names)], [*kept, *names])
            made.clear()
            gc.collect()  # a tree's nodes refer to each other
            yield out

    return spread(pages.select("url", "html", *keep)).mapInArrow(run, schema)


def register(spark) -> None:
    """SQL functions over HTML: extract_links(html, url) as a table, clean_html(html) as a value."""
    from pyspark.sql.functions import pandas_udf, udtf

    @udtf(returnType="pos int, url string, text string, is_internal boolean")
    class ExtractLinks:
        def eval(self, html: str, url: str):
            for i, link in enumerate(links(parse(html or ""), url or "")):
                yield i, link["url"], link["text"], link["is_internal"]

    @pandas_udf("string")
    def clean_html(html: pd.Series) -> pd.Series:
        return html.map(lambda h: cleaned(h or "")["text"])

    spark.udtf.register("extract_links", ExtractLinks)
    spark.udf.register("clean_html", clean_html)
