"""HTML pages as nested records: a tree builder, a subset of CSS selectors, and Arrow functions that parse once."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the page model: which elements have no content, whose text counts, which attributes list words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title svg".split())  # not part of a page's text
UNREAD = frozenset("script style template".split())  # not part of an element's text
MULTI = frozenset("class rel rev accept-charset headers accesskey dropzone".split())  # attributes that list words

FIELD_TYPES = {
    "title": "string",
    "text": "string",
    "links": "array<string>",
    "metadata": "struct<title:string,description:string,keywords:array<string>,canonical:string,language:string>",
    "images": "array<struct<src:string,alt:string>>",
    "headings": "struct<h1:array<string>,h2:array<string>,h3:array<string>>",
    "tables": "array<struct<headers:array<string>,rows:array<array<string>>>>",
    "lists": "array<struct<type:string,items:array<string>>>",
}
PAGE_FIELDS = list(FIELD_TYPES)
DEFAULT_SELECTORS = {"title": "title", "description": 'meta[name="description"]'}


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """Descendant elements in document order, without recursion."""
        stack = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Element):
                    yield x
                    stack.append(iter(x.children))
                    break
            else:
                stack.pop()

    def strings(self, hidden):
        """Text nodes in document order, but for those strictly inside hidden elements."""
        stack = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    yield x
                elif x.tag not in hidden:
                    stack.append(iter(x.children))
                    break
            else:
                stack.pop()

    def words(self) -> str:
        return " ".join(" ".join(self.strings(UNREAD)).split())

    def closest(self, tag):
        at = self.parent
        while at is not None and at.tag != tag:
            at = at.parent
        return at


class Builder(HTMLParser):
    """An end tag closes the nearest open element of its name; others are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        new = Element(tag, {k: v if v is not None else "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        children = self.at.children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def tree(html: str | None) -> Element:
    """The document tree; any text has one. A last tag that doesn't end is dropped."""
    builder = Builder()
    text = html or ""
    cut = re.search(r"<[A-Za-z/!][^<>]*\Z", text)
    builder.feed(text[: cut.start()] if cut else text)
    builder.close()
    return builder.root


# ---------------------------------------------------------------- selectors
STEP = re.compile(r"""([\w*-]+)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*))\s*)?\]""")


def compound(text: str):
    tests, at = [], 0
    while at < len(text):
        m = STEP.match(text, at)
        if m is None:
            raise ValueError(f"selector {text!r} isn't supported")
        tag, ident, cls, attr, op, *quoted = m.groups()
        value = next((q for q in quoted if q is not None), "")
        if tag:
            tests.append(lambda e, t=tag.lower(): t == "*" or e.tag == t)
        elif ident:
            tests.append(lambda e, v=ident: e.attrs.get("id") == v)
        elif cls:
            tests.append(lambda e, v=cls: v in e.attrs.get("class", "").split())
        else:
            tests.append(lambda e, a=attr.lower(), o=op, v=value: a in e.attrs and (o is None or attribute_is(e.attrs[a], o, v)))
        at = m.end()
    return lambda e: all(t(e) for t in tests)


def attribute_is(have: str, op: str, want: str) -> bool:
    if op == "=":
        return have == want
    if op == "~=":
        return want in have.split()
    if op == "|=":
        return have == want or have.startswith(f"{want}-")
    return bool(want) and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[op](want)


def selector(text: str):
    """A predicate on elements; compounds, descendants, children (>) and lists (,)."""
    chains = []
    for part in re.split(r",(?![^\[]*\])", text):
        tokens = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", part.strip())
        if not tokens or tokens[0] == ">" or tokens[-1] == ">":
            raise ValueError(f"selector {text!r} isn't supported")
        chains.append([t if t == ">" else compound(t) for t in tokens])

    def fits(e, chain):
        *rest, last = chain
        if not last(e):
            return False
        if not rest:
            return True
        if rest[-1] == ">":
            return e.parent is not None and e.parent.parent is not None and fits(e.parent, rest[:-1])
        up = e.parent
        while up is not None and up.parent is not None:
            if fits(up, rest):
                return True
            up = up.parent
        return False

    return lambda e: any(fits(e, c) for c in chains)


def select(root: Element, css: str) -> list[Element]:
    match = selector(css)
    return [e for e in root.walk() if match(e)]


# ---------------------------------------------------------------- extraction
def join(base: str, ref: str) -> str | None:
    try:
        return urljoin(base, ref)
    except ValueError:
        return None


def base_url(root: Element, url: str) -> str:
    for e in root.walk():
        if e.tag == "base" and e.attrs.get("href"):
            return join(url, e.attrs["href"].strip()) or url
    return url


def links(root: Element, base: str) -> list[str]:
    found = {}
    for e in root.walk():
        href = e.attrs.get("href", "").strip() if e.tag == "a" else ""
        if href and not href.startswith("#") and (full := join(base, href)):
            full = urldefrag(full)[0]
            try:
                if urlsplit(full).scheme in ("http", "https"):
                    found[full] = None
            except ValueError:
                continue
    return list(found)


def page_text(root: Element, css: str | None = None) -> str:
    tops = [root] if css is None else select(root, css)
    return " ".join(" ".join(s for top in tops for s in top.strings(HIDDEN)).split())


def meta(root: Element, name: str) -> str | None:
    for e in root.walk():
        if e.tag == "meta" and e.attrs.get("name", "").lower() == name:
            return e.attrs["content"].strip() if "content" in e.attrs else None
    return None


def metadata(root: Element) -> dict:
    first = lambda test: next((e for e in root.walk() if test(e)), None)
    title = first(lambda e: e.tag == "title")
    link = first(lambda e: e.tag == "link" and "canonical" in e.attrs.get("rel", "").lower().split())
    top = first(lambda e: e.tag == "html")
    return {
        "title": " ".join(" ".join(title.strings(frozenset())).split()) if title else None,
        "description": meta(root, "description"),
        "keywords": [k for k in (k.strip() for k in (meta(root, "keywords") or "").split(",")) if k],
        "canonical": link.attrs.get("href") if link else None,
        "language": top.attrs.get("lang") if top else None,
    }


def images(root: Element, base: str) -> list[dict]:
    out = []
    for e in root.walk():
        src = e.attrs.get("src", "").strip() if e.tag == "img" else ""
        if src:
            out.append({"src": join(base, src) or src, "alt": e.attrs["alt"].strip() if "alt" in e.attrs else None})
    return out


def headings(root: Element) -> dict:
    out = {"h1": [], "h2": [], "h3": []}
    for e in root.walk():
        if e.tag in out and (text := e.words()):
            out[e.tag].append(text)
    return out


def tables(root: Element) -> list[dict]:
    out = []
    for t in root.walk():
        if t.tag != "table":
            continue
        heads, rows = [], []
        for r in t.walk():
            if r.tag == "tr" and r.closest("table") is t:
                cells = [c for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")]
                if cells and not heads and not rows and all(c.tag == "th" for c in cells):
                    heads = [c.words() for c in cells]
                elif cells:
                    rows.append([c.words() for c in cells])
        if heads or rows:
            out.append({"headers": heads, "rows": rows})
    return out


def lists(root: Element) -> list[dict]:
    out = []
    for e in root.walk():
        if e.tag in ("ul", "ol"):
            items = [text for c in e.children if isinstance(c, Element) and c.tag == "li" and (text := c.words())]
            if items:
                out.append({"type": e.tag, "items": items})
    return out


PARTS = {
    "title": lambda root, base: metadata(root)["title"],
    "text": lambda root, base: page_text(root),
    "links": links,
    "metadata": lambda root, base: metadata(root),
    "images": images,
    "headings": lambda root, base: headings(root),
    "tables": lambda root, base: tables(root),
    "lists": lambda root, base: lists(root),
}


def page_of(root: Element, url: str, fields: list[str] = PAGE_FIELDS) -> dict:
    """The wanted fields of the canonical page record; missing parts are null or empty."""
    base = base_url(root, url) if {"links", "images"} & set(fields) else url
    return {f: PARTS[f](root, base) for f in fields}


def parse_page(html: str | None, url: str | None, fields: list[str] = PAGE_FIELDS) -> dict:
    return page_of(tree(html), url or "", fields)


def value_of(e: Element, attr: str | None) -> str | None:
    if attr is None and e.tag == "meta":
        attr = "content"
    if attr is None:
        return e.words()
    have = e.attrs.get(attr)
    if have is None:
        return None
    return " ".join(have.split()) if attr in MULTI else have.strip()


def extract(root: Element, selectors: dict) -> dict:
    out = {}
    for name, spec in selectors.items():
        spec = {"selector": spec} if isinstance(spec, str) else spec
        found = select(root, spec["selector"])
        if spec.get("all"):
            out[name] = [v for e in found if (v := value_of(e, spec.get("attr"))) is not None]
        else:
            out[name] = value_of(found[0], spec.get("attr")) if found else None
    return out


def parse_selector(text: str) -> tuple[str, str]:
    """NAME=CSS, cut at the first =."""
    name, _, css = text.partition("=")
    if not name.strip() or not css.strip():
        raise ValueError(f"expected NAME=CSS, not {text!r}")
    return name.strip(), css.strip()


# ---------------------------------------------------------------- columns
def parse_html(html: Column | str, url: Column | str, fields: list[str] = PAGE_FIELDS, parser=parse_page, selectors: dict | None = None) -> Column:
    """struct of the wanted fields and parse_error, from one parse of each page.

    parser(html, url, fields) gives a dictionary; one that raises leaves the fields of an empty page and its error in
    parse_error. With selectors, a field data holds the selected parts of the same tree; parser is not asked then.
    """
    wanted = {f: FIELD_TYPES[f] for f in fields}
    if selectors is not None:
        wanted["data"] = _selected_type(selectors).simpleString()
    ddl = ", ".join(f"`{f}` {t}" for f, t in wanted.items()) + ", parse_error string"

    def one(h, u):
        try:
            if selectors is None:
                return parser(h, u, fields) | {"parse_error": None}
            root = tree(h)
            return page_of(root, u or "", fields) | {"data": extract(root, selectors), "parse_error": None}
        except Exception as e:  # of any parser
            empty = page_of(tree(""), u or "", fields) | ({"data": extract(tree(""), selectors)} if selectors is not None else {})
            return empty | {"parse_error": f"cannot parse page: {type(e).__name__}: {e}"}

    @F.pandas_udf(ddl)
    def parsed(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(a, b) for a, b in zip(h, u)], columns=[*wanted, "parse_error"])

    return parsed(html, url)


def _selected_type(selectors: dict) -> T.StructType:
    for spec in selectors.values():
        selector(spec if isinstance(spec, str) else spec["selector"])
    return T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if not isinstance(v, str) and v.get("all") else T.StringType()) for k, v in selectors.items()])


def extract_data(html: Column | str, selectors: dict | None = None) -> Column:
    """struct with a field for each named selector: string, or array of strings if the selector says all."""
    named = DEFAULT_SELECTORS if selectors is None else selectors

    @F.pandas_udf(_selected_type(named))
    def extracted(h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(tree(x), named) for x in h], columns=list(named))

    return extracted(html)


def extract_text(html: Column | str, css: str | None = None) -> Column:
    @F.pandas_udf("string")
    def text(h: pd.Series) -> pd.Series:
        return h.map(lambda x: page_text(tree(x), css), na_action=None)

    return text(html)


def is_html(headers: Column | str) -> Column:
    """From a header map: no or an empty content type counts as HTML; names in any case."""
    headers = F.col(headers) if isinstance(headers, str) else headers
    kinds = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "content-type"))
    kind = F.lower(F.coalesce(F.get(kinds, F.lit(0)), F.lit("")))
    return (F.trim(kind) == "") | kind.contains("html")
