"""A light document tree over the standard HTML tokenizer, with selectors, cleaning, markdown, links and metadata.

End tags that HTML lets one leave out are implied; an unclosed inline element ends with the block around it. Markdown
text is written as it is, without backslash escapes. Everything here is plain Python that Arrow-batched operators call
once a page.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from . import constants as C

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: An opening tag of the key ends an open element of the value.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A tree is no deeper: what stands deeper becomes a sibling, as in browsers, so that no walk up or down costs more than this by element.
MAX_DEPTH = 256
#: Quotes and lists that stand deeper within others of their kind are not marked or indented once more.
MAX_NESTED = 32
SPACE = "\t\n\v\f\r                  　﻿"


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at, self.depth = self.root, 0

    def _leave(self, n: Node) -> None:
        """Closes n, an open element, and all that is open in it."""
        while self.at is not n:
            self.at, self.depth = self.at.parent, self.depth - 1
        self.at, self.depth = n.parent, self.depth - 1

    def _close(self, tags: set[str], within: frozenset[str]) -> None:
        n = self.at
        while n.parent is not None and n.tag not in within:
            if n.tag in tags:
                self._leave(n)
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close({"p"}, frozenset({"td", "th", "table", "body", "#root"}))
        if tag in ENDS:
            for _ in range(2):
                self._close(ENDS[tag], frozenset({"ul", "ol", "dl", "table", "select", "#root"}))
        if self.depth >= MAX_DEPTH and tag not in VOID:
            self._leave(self.at)
        n = Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at, self.depth = n, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self._leave(n)
                return
            n = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
_SIMPLE = re.compile(rf"""\#({_NAME})|\.({_NAME})|\[\s*([\w:-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:([\w-]+)(\()?""")
_TAG, _BETWEEN = re.compile(rf"{_NAME}|\*"), re.compile(r"\s*([>+~,])\s*|\s+|$")
#: Pseudo-classes that count elements: from which end, and whether of one tag only.
_NTH = {"nth-child": (0, False), "nth-last-child": (1, False), "nth-of-type": (0, True), "nth-last-of-type": (1, True)}
_FIXED = {"first-child": [("nth-child", (0, 1))], "last-child": [("nth-last-child", (0, 1))], "first-of-type": [("nth-of-type", (0, 1))], "last-of-type": [("nth-last-of-type", (0, 1))], "only-child": [("nth-child", (0, 1)), ("nth-last-child", (0, 1))], "only-of-type": [("nth-of-type", (0, 1)), ("nth-last-of-type", (0, 1))]}


def _formula(text: str) -> tuple[int, int]:
    """(a, b) of an+b, odd, even."""
    t = re.sub(r"\s+", "", text.lower())
    t = {"odd": "2n+1", "even": "2n"}.get(t, t)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", t)
    if not t or not m:
        raise ValueError(f"not a formula: {text!r}")
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    return a, int(m[2] or 0)


def _closing(css: str, at: int) -> int:
    """The place of the bracket that closes the one before at; quoted brackets don't count."""
    depth, quote = 1, ""
    for i in range(at, len(css)):
        c = css[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
    raise ValueError(f"selector not understood: {css!r}")


def compile_selector(css: str) -> list[list[tuple]]:
    """Alternatives, each a list of (combinator before, tag, tests).

    Tags, #id, .class, attributes; descendants, children (>), next (+) and later (~) siblings; :not, :is, :nth-child and its kin, :empty, :contains.
    A ValueError where it isn't understood.
    """
    css = css.strip()
    out, steps, before, at = [], [], " ", 0
    if not css:
        raise ValueError("an empty selector")
    while at < len(css):
        m = _TAG.match(css, at)
        tag, tests, start = (m[0] if m else ""), [], at
        at = m.end() if m else at
        while m := _SIMPLE.match(css, at):
            at = m.end()
            name, inside = m[8], None
            if m[9]:
                end = _closing(css, at)
                inside, at = css[at:end], end + 1
            if name is None:
                value = next((v for v in m.group(5, 6, 7) if v is not None), "")
                tests.append((m[1] or "", m[2] or "", m[3] or "", m[4] or "", value))
            elif name in _NTH and inside is not None:
                tests.append(("", "", ":", name, _formula(inside)))
            elif name in _FIXED and inside is None:
                tests += [("", "", ":", kind, formula) for kind, formula in _FIXED[name]]
            elif name in ("not", "is", "where", "matches") and inside is not None:
                tests.append(("", "", ":", "not" if name == "not" else "is", compile_selector(inside)))
            elif name == "contains" and inside is not None:
                tests.append(("", "", ":", name, inside.strip().strip("\"'")))
            elif name in ("empty", "root") and inside is None:
                tests.append(("", "", ":", name, None))
            else:
                raise ValueError(f"selector not understood: {css!r}")
        m = _BETWEEN.match(css, at)
        if at == start or not m:
            raise ValueError(f"selector not understood: {css!r}")
        steps.append((before, tag, tests))
        at, before = m.end(), m[1] or " "
        if before == "," or at >= len(css):
            if at >= len(css) and m[1]:
                raise ValueError(f"selector not understood: {css!r}")
            out.append(steps)
            steps, before = [], " "
    return out


class _Matcher:
    """Selectors against one tree, from the right to the left. Each element is tried once a step, and children are listed once a parent, so that no nesting or width squares."""

    def __init__(self):
        self.known: dict[tuple, bool] = {}
        self.kids: dict[int, tuple[list[Node], dict[int, int]]] = {}
        self.places: dict[tuple, dict[int, int]] = {}
        self.first: dict[tuple, int] = {}

    def of(self, parent: Node) -> tuple[list[Node], dict[int, int]]:
        if id(parent) not in self.kids:
            own = [c for c in parent.children if isinstance(c, Node)]
            self.kids[id(parent)] = own, {id(c): i for i, c in enumerate(own)}
        return self.kids[id(parent)]

    def place(self, n: Node, kind: str) -> int:
        """From 1: n's place among its siblings (of its tag, from the end)."""
        back, typed = _NTH[kind]
        key = (id(n.parent), kind)
        if key not in self.places:
            own, count, out = self.of(n.parent)[0], {}, {}
            for c in reversed(own) if back else own:
                t = c.tag if typed else ""
                count[t] = out[id(c)] = count.get(t, 0) + 1
            self.places[key] = out
        return self.places[key][id(n)]

    def pseudo(self, n: Node, kind: str, value) -> bool:
        if kind in _NTH:
            (a, b), k = value, self.place(n, kind)
            return k == b if not a else (k - b) % a == 0 and (k - b) // a >= 0
        if kind in ("not", "is"):
            return any(self.fits(n, w) for w in value) == (kind == "is")
        if kind == "contains":
            return value in n.text()
        return not n.children if kind == "empty" else n.tag == "html"

    def fits(self, n: Node, steps: list[tuple], k: int | None = None) -> bool:
        """Whether n fits the steps up to the k-th, the last by default."""
        k = len(steps) - 1 if k is None else k
        key = (id(n), id(steps), k)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = self.try_(n, steps, k)
        return got

    def try_(self, n: Node, steps: list[tuple], k: int) -> bool:
        before, tag, tests = steps[k]
        if not _fits(n, tag, tests, self):
            return False
        if not k:
            return True
        p = n.parent
        if before in "+~":
            own, at = self.of(p)
            i = at[id(n)]
            if before == "+":
                return i > 0 and self.fits(own[i - 1], steps, k - 1)
            first = (id(p), id(steps), k)
            if first not in self.first:
                self.first[first] = next((i for i, c in enumerate(own) if self.fits(c, steps, k - 1)), len(own))
            return self.first[first] < i
        while p is not None and p.tag != "#root":
            if self.fits(p, steps, k - 1):
                return True
            if before == ">":
                return False
            p = p.parent
        return False


def _fits(n: Node, tag: str, tests: list, matcher: _Matcher | None = None) -> bool:
    if tag not in ("", "*") and n.tag != tag.lower():
        return False
    for ident, cls, name, op, value in tests:
        if name == ":":
            if not matcher.pseudo(n, op, value):
                return False
            continue
        if ident and n.attrs.get("id") != ident or cls and cls not in n.attrs.get("class", "").split():
            return False
        if name:
            v = n.attrs.get(name.lower())
            if v is None:
                return False
            if op and not {"=": v == value, "*=": bool(value) and value in v, "^=": bool(value) and v.startswith(value), "$=": bool(value) and v.endswith(value), "~=": value in v.split(), "|=": v == value or v.startswith(value + "-")}[op]:
                return False
    return True


_compiled: dict[str, list] = {}


def select(root: Node, css: str) -> list[Node]:
    ways = _compiled.get(css) or _compiled.setdefault(css, compile_selector(css))
    matcher = _Matcher()
    return [n for n in root.walk() if n.tag != "#root" and any(matcher.fits(n, w) for w in ways)]


def _html(n: Node | str) -> str:
    out: list[str] = []
    stack: list[Node | str | tuple] = [n]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        else:
            out.append(f"<{x.tag}" + "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in x.attrs.items()) + ">")
            if x.tag not in VOID:
                stack.append((f"</{x.tag}>",))
                stack.extend(reversed(x.children))
    return "".join(out)


def inner_html(n: Node) -> str:
    return "".join(_html(c) for c in n.children)


class _Test:
    """Whether a node fits any of some selectors of one step, by its tag or by the attributes that it has."""

    def __init__(self, selectors):
        self.tags: set[str] = set()
        self.attrs: dict[str, list[tuple]] = {}
        for css in selectors:
            for steps in compile_selector(css):
                (_, tag, tests), = steps
                if tests:
                    name = tests[0][2].lower() or ("id" if tests[0][0] else "class")
                    self.attrs.setdefault(name, []).append((tag, tests))
                else:
                    self.tags.add(tag.lower())

    def __call__(self, n: Node) -> bool:
        if n.tag in self.tags:
            return True
        for name in n.attrs:
            for tag, tests in self.attrs.get(name, ()):
                if _fits(n, tag, tests):
                    return True
        return False


@functools.cache
def _noise(keep_nav: bool, keep_footer: bool) -> tuple[_Test, _Test]:
    spared = {x for x, keep in (("nav", keep_nav), ('[role="navigation"]', keep_nav), ("footer", keep_footer), ('[role="contentinfo"]', keep_footer)) if keep}
    return _Test(C.REMOVED_TAGS), _Test(x for x in C.NOISE if x not in spared)


def clean(root: Node, keep_nav: bool = False, keep_footer: bool = False) -> Node:
    """Takes noise out of the tree (in place, in one walk) and gives the main content, or the body."""
    removed, noise = _noise(keep_nav, keep_footer)
    stack = [root]
    while stack:
        n = stack.pop()
        kept = [c for c in n.children if not isinstance(c, Node) or not (removed(c) or (c.tag not in ("main", "article") and noise(c)))]
        if len(kept) < len(n.children):
            n.children = kept
        stack.extend(c for c in kept if isinstance(c, Node))
    main = body = None
    empty = lambda n: n.tag in ("div", "span", "p") and not any(isinstance(c, Node) for c in n.children) and not "".join(n.children).strip(SPACE)
    # an element that only holds empty ones stays: what is empty is told before any of them goes
    gone = {id(n) for n in root.walk() if empty(n)}
    for n in list(root.walk()):
        kept = [c for c in n.children if id(c) not in gone]
        if len(kept) < len(n.children):
            n.children = kept
        if id(n) in gone:
            continue
        if main is None and (n.tag in ("main", "article") or n.attrs.get("role") == "main"):
            main = n
        if body is None and n.tag == "body":
            body = n
    if main is not None and len(main.text().strip(SPACE)) > 100:
        return main
    return body if body is not None else root


_RUN = re.compile(f"[{SPACE}]+")


_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Whole(str):
    """A block's text between blank lines that an element around it need not look at again."""


def _leaf(n: Node) -> str | None:
    """The text of an element in a line whose children aren't read one by one, else None."""
    if n.tag == "br":
        return "  \n"
    if n.tag == "img":
        side = lambda k: int(m[0]) if (m := re.match(r"\d{1,9}", n.attrs.get(k, ""))) else 100
        src, alt = n.attrs.get("src", ""), n.attrs.get("alt", "")
        bad = side("width") <= 1 or side("height") <= 1 or not src or src.startswith("data:image/gif") or not alt
        return "" if bad else f"![{alt}]({src})"
    return _marked(n.text(), "`") if n.tag == "code" else None


def _marked(t: str, mark: str) -> str:
    core = t.strip()
    return t if not core else t[: len(t) - len(t.lstrip())] + mark + core + mark + t[len(t.rstrip()) :]


def _inside(n: Node) -> list[Node | str]:
    """The children that count in n's markdown."""
    if n.tag in ("ul", "ol"):
        return [c for c in n.children if isinstance(c, Node) and c.tag == "li"]
    return [] if n.tag in ("pre", "hr") else n.children


def _block(n: Node, parts: list[str], deep: bool) -> str:
    """The markdown of a block element whose children's is `parts`; deep: past MAX_NESTED of its kind."""
    if n.tag == "pre":
        code = next((c for c in n.children if isinstance(c, Node) and c.tag == "code"), None)
        m = re.search(r"lang(?:uage)?-([\w+-]+)", code.attrs.get("class", "")) if code is not None else None
        return f"```{m[1] if m else ''}\n{n.text().rstrip()}\n```"
    if n.tag == "hr":
        return "---"
    if n.tag in ("ul", "ol"):
        if deep:
            return "\n".join(p.strip() for p in parts)
        return "\n".join(("-   " if n.tag == "ul" else f"{k}.  ") + p.strip().replace("\n", "\n    ") for k, p in enumerate(parts, 1))
    said = [p for p in parts if p != " "] if len(parts) < 4 else parts
    if len(said) == 1 and isinstance(said[0], _Whole):
        body = said[0][2:-2]
    else:
        body = "".join(parts)
        body = re.sub(r"[ \t]*\n[ \t]*(?!\S)", "\n", body).strip(" \n") if n.tag != "#root" else body.strip()
    if n.tag in _HEADS:
        return "#" * int(n.tag[1]) + " " + body if body else ""
    if n.tag == "blockquote" and not deep:
        return "> " + body.replace("\n", "\n> ")
    return body


_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NESTED = frozenset(("blockquote", "ul", "ol"))
_OWN = _HEADS | {"pre", "hr", "ul", "ol", "blockquote"}


def _line(n: Node, parts: list[str], deep: bool) -> str:
    """The markdown, within a line, of an element whose children's is `parts`."""
    if n.tag in BLOCK:
        body = _block(n, parts, deep)
        return (_Whole if n.tag not in _OWN or n.tag == "blockquote" and body.strip("> ") else str)("\n\n" + body + "\n\n")
    t = "".join(parts)
    if n.tag == "a":
        t = t.strip()
        return "" if not t else f"[{t}]({n.attrs['href']})" if n.attrs.get("href") else t
    return _marked(t, _MARKS[n.tag]) if n.tag in _MARKS else t


def _blocks(n: Node) -> str:
    """The markdown of a block element's content. Elements are closed from the leaves up, without recursion."""
    stack: list[tuple] = [(n, False, iter(_inside(n)), [])]
    while True:
        at, in_line, todo, parts = stack[-1]
        for c in todo:
            if isinstance(c, str):
                parts.append(_RUN.sub(" ", c))
                continue
            item = at.tag in ("ul", "ol")
            t = None if item else _leaf(c)
            if t is not None:
                parts.append(t)
                continue
            stack.append((c, not item, iter(_inside(c) if item or c.tag in BLOCK else c.children), []))
            break
        else:
            stack.pop()
            deep = at.tag in _NESTED and sum(f[0].tag in _NESTED for f in stack) >= MAX_NESTED
            t = _line(at, parts, deep) if in_line else _block(at, parts, deep)
            if not stack:
                return t
            stack[-1][3].append(t)


def markdown(n: Node) -> str:
    md = re.sub(r"\n{3,}", "\n\n", _blocks(n))
    return re.sub(r"[ \t]+(?=\n|$)", "", md).strip(SPACE)


def links(root: Node, base: str) -> list[tuple[str, str, str | None, bool]]:
    """(url, text, rel, internal) of each page's links, first of each url. Nothing where the base isn't an absolute url."""
    try:
        home = urlsplit(base)
    except ValueError:
        return []
    if not home.scheme or not home.hostname:
        return []
    out: dict[str, tuple] = {}
    for a in root.walk():
        href = a.attrs.get("href", "") if a.tag == "a" else ""
        if not href or href.startswith(("mailto:", "tel:", "javascript:", "#")):
            continue
        try:
            u = urlsplit(urljoin(base, href.strip(SPACE)))
            host = u.hostname
        except ValueError:
            continue
        url = u._replace(fragment="", netloc=u.netloc.lower(), path=u.path or ("/" if u.netloc else "")).geturl().rstrip("/")
        if url not in out:
            out[url] = (url, a.text().strip(SPACE)[:200], a.attrs.get("rel"), host == home.hostname)
    return list(out.values())


def agent_links(root: Node, base: str) -> list[tuple[str, str]]:
    """(address, text of at most 120 characters) of the page's http links, hashes and all, each address once."""
    out: dict[str, str] = {}
    for a in root.walk():
        if a.tag == "a" and "href" in a.attrs:
            try:
                href = urljoin(base, a.attrs["href"].strip(SPACE))
            except ValueError:
                continue
            if href.startswith("http") and href not in out:
                out[href] = a.text().strip(SPACE)[:120]
    return list(out.items())


def metadata(root: Node, url: str) -> dict:
    metas = [n for n in root.walk() if n.tag == "meta"]

    def get(name: str) -> str:
        for attr, want in (("name", name), ("property", name), ("property", f"og:{name}")):
            for m in metas:
                if m.attrs.get(attr) == want and m.attrs.get("content"):
                    return m.attrs["content"]
        return ""

    first = lambda css: next(iter(select(root, css)), None)
    title, html, canonical = first("title"), first("html"), first('link[rel="canonical"]')
    return {
        "title": (title.text().strip(SPACE) if title else "") or get("title"), "description": get("description"),
        "language": (html.attrs.get("lang", "") if html else "") or get("language"), "author": get("author"),
        "published_at": get("article:published_time") or get("datePublished"), "og_image": get("image") or get("og:image") or None,
        "canonical": (canonical.attrs.get("href") if canonical else None) or url, "robots": get("robots") or None,
    }


def json_ld(root: Node) -> list[str]:
    import json

    out = []
    for n in root.walk():
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                out.append(json.dumps(json.loads(n.text()), separators=(",", ":"), ensure_ascii=False))
            except (ValueError, RecursionError):
                continue
    return out


def tables(root: Node) -> list[dict]:
    out = []
    for t in select(root, "table"):
        headers = [c.text().strip(SPACE) for c in t.walk() if c.tag == "th"]
        rows = [[c.text().strip(SPACE) for c in r.walk() if c.tag == "td"] for r in t.walk() if r.tag == "tr"]
        out.append({"headers": headers, "rows": [r for r in rows if r]})
    return out
