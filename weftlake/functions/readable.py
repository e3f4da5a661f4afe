"""The article of a page by text density: blocks of prose vote for the elements around them, the best one is taken out."""

from __future__ import annotations

import re

from . import constants as C, dom

#: Longer pages are no articles; blocks of fewer characters don't vote; what stands nearer than this share to the best joins it.
MAX_HTML, MIN_BLOCK, SIBLING = 5_000_000, 25, 0.2
_VOTERS = frozenset(("p", "pre", "td", "blockquote", "li", "dd"))
_SKIPPED = frozenset(("script", "style", "noscript", "iframe", "svg", "nav", "footer", "aside", "form", "head", "template"))
_LIKELY, _UNLIKELY = re.compile(r"(?i)article|body|content|entry|main|post|story|text"), re.compile(r"(?i)comment|combx|foot|masthead|menu|promo|related|share|sidebar|sponsor|tags|widget")


def _measures(root: dom.Node) -> dict[int, tuple[int, int, int]]:
    """Of each element outside what is skipped: characters of text, those inside links, commas. Children come before parents."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in n.children if isinstance(c, dom.Node) and c.tag not in _SKIPPED)
    out: dict[int, tuple[int, int, int]] = {}
    for n in reversed(order):
        chars = linked = commas = 0
        for c in n.children:
            if isinstance(c, str):
                t = " ".join(c.split())
                chars, commas = chars + len(t), commas + t.count(",")
            elif id(c) in out:
                a, b, k = out[id(c)]
                chars, linked, commas = chars + a, linked + b, commas + k
        out[id(n)] = (chars, chars if n.tag == "a" else linked, commas)
    return out


def article(root: dom.Node, html: str) -> dict:
    """ok, title, byline, excerpt, content (a node that only lists what was chosen) and text. The tree stays as it is.

    ok is false for pages over MAX_HTML characters and for pages without a block of prose; the rest is then null.
    """
    nothing = {"ok": False, "title": None, "byline": None, "excerpt": None, "content": None, "text": None}
    if not html or len(html) > MAX_HTML:
        return nothing
    size = _measures(root)
    votes: dict[int, float] = {}
    seen: dict[int, dom.Node] = {}
    for n in root.walk():
        if n.tag not in _VOTERS or id(n) not in size or size[id(n)][0] < MIN_BLOCK:
            continue
        chars, linked, commas = size[id(n)]
        vote = (1 + commas + min(chars / 100, 3)) * (1 - linked / chars)
        for up, share in ((n.parent, 1.0), (n.parent.parent if n.parent else None, 0.5)):
            if up is not None and up.tag != "#root":
                seen[id(up)] = up
                votes[id(up)] = votes.get(id(up), 0.0) + vote * share
    if not votes:
        return nothing
    for k, n in seen.items():
        name = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
        votes[k] *= (1 - size[k][1] / max(size[k][0], 1)) * (1.25 if n.tag in ("article", "main") or _LIKELY.search(name) else 0.5 if _UNLIKELY.search(name) else 1.0)
    best = seen[max(votes, key=votes.get)]
    parts = [best]
    if best.parent is not None and best.tag not in ("body", "html"):
        floor = max(10.0, votes[id(best)] * SIBLING)
        near = [c for c in best.parent.children if isinstance(c, dom.Node)]
        parts = [c for c in near if c is best or votes.get(id(c), 0.0) >= floor or (c.tag == "p" and size.get(id(c), (0, 0, 0))[0] > 80 and size[id(c)][1] < 0.25 * size[id(c)][0])]
    kept = dom.Node("div", {}, None)
    kept.children = [_copy(p, kept) for p in parts]
    text = " ".join(kept.text().split())
    first = next((" ".join(p.text().split()) for p in kept.walk() if p.tag == "p" and p.text().strip()), None)
    meta = dom.metadata(root, "")
    by = next((" ".join(n.text().split()) for n in root.walk() if n.attrs.get("rel") == "author" or "byline" in n.attrs.get("class", "").lower()), None)
    return {"ok": bool(text), "title": meta["title"] or None, "byline": meta["author"] or by or None, "excerpt": meta["description"] or first, "content": kept, "text": text}


def _copy(n: dom.Node, parent: dom.Node) -> dom.Node:
    """A copy of the subtree without what is skipped, so that cleaning the page later can't reach into it."""
    top = dom.Node(n.tag, n.attrs, parent)
    stack = [(n, top)]
    while stack:
        old, new = stack.pop()
        for c in old.children:
            if isinstance(c, str):
                new.children.append(c)
            elif c.tag not in _SKIPPED and c.tag not in C.REMOVED_TAGS:
                copy = dom.Node(c.tag, c.attrs, new)
                new.children.append(copy)
                stack.append((c, copy))
    return top
