"""HTML as blocks of text with their path through the page's elements: a helper of site trees."""

from __future__ import annotations

import re
from html import unescape

import xxhash

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())  # their content has no tags
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s
    samp small span strike strong sub sup time tt u var wbr""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul""".split())
# An element of the first kind ends an open one of the second, unless one of the third lies between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
# Elements that never hold the main text, and those that do so nowhere but in an article.
NEVER = frozenset("""nav footer aside form script style title textarea iframe noembed noframes xmp noscript template head select
    button dialog menu svg object canvas audio video""".split())
NOT_OUTSIDE = frozenset(["header"])
LANDMARKS = frozenset(["article", "main"])
# Words of class names, ids and roles that say the same of an element.
NEVER_WORDS = frozenset("""ad ads adbox adslot advert adverts advertisement advertisements advertising adsense banner promo promos
    promotion promoted sponsor sponsors sponsored
    nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar
    footer contentinfo sidebar sidebars aside complementary widget widgets related recommended recommendations teaser teasers
    notice notices cookie cookies consent gdpr alert popup modal overlay dialog alertdialog newsletter subscribe signup login
    comment comments commentlist disqus reply replies respond
    share sharing social search searchbox form hidden""".split())
NOT_OUTSIDE_WORDS = frozenset("header masthead topbar".split())
NEGATED = frozenset("no has have with without not is".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)>?|<[!?/][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
STYLE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
KEEP, OUTSIDE_ONLY, DROP = 0, 1, 2
KNOWN = 50_000  # elements whose attributes are remembered


def _says(name: str, never: frozenset) -> bool:
    """A name whose first or last part is one of the words; no-sidebar is about another element."""
    parts = [p.lower() for p in NAMED.findall(name)]
    return bool(parts) and parts[0] not in NEGATED and (parts[-1] in never or parts[0] in never)


def element(tag: str, attributes: str) -> tuple[str, int]:
    """The label that an element has in a site's tree (tag and names without digits), and what is known of its role."""
    role = DROP if tag in NEVER else OUTSIDE_ONLY if tag in NOT_OUTSIDE else KEEP
    if not attributes or attributes.isspace():
        return tag, role
    names, hidden = [], False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            names += unescape(value).split()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and STYLE_HIDDEN.search(value):
            hidden = True
    if hidden:
        role = DROP
    elif role != DROP and tag not in LANDMARKS and tag not in ("html", "body"):
        if any(_says(n, NEVER_WORDS) for n in names):
            role = DROP
        elif any(_says(n, NOT_OUTSIDE_WORDS) for n in names):
            role = OUTSIDE_ONLY
    elif tag in LANDMARKS and any(_says(n, NEVER_WORDS) for n in names):
        role = DROP  # a comment or a teaser that is marked up as an article
    if tag not in LANDMARKS and ("main" in names and "role" in attributes.lower() or "articleBody" in attributes):
        tag = "main"
    shown = sorted({"".join(ch for ch in n.lower() if not ch.isdigit()) for n in names})
    return " ".join([tag, *shown]), role


class Block:
    """Text without a block border inside, where it lies, how many of its signs are links, and what its role says."""

    __slots__ = ("path", "text", "linked", "dropped", "article")

    def __init__(self, path, text, linked, dropped, article):
        self.path, self.text, self.linked, self.dropped, self.article = path, text, linked, dropped, article


class Elements(dict):
    """What `element` says of tag and attributes, remembered."""

    def __missing__(self, key):
        if len(self) > KNOWN:
            self.clear()
        value = self[key] = element(*key)
        return value


def path_of(parent: int, label: str) -> int:
    """A 63-bit name for an element's way from the root."""
    return xxhash.xxh3_64_intdigest(parent.to_bytes(8, "little") + label.encode()) >> 1


class Page:
    """One pass over a page: its blocks in order, and its elements with their children.

    `blocks` are the texts, `children` maps the path of an element to the labels of the block
    elements in it, and `parents` to its parent's path. Elements left open end where HTML
    ends them; a part that is never closed ends at the next article. Text in scripts, styles
    and their like is none.
    """

    def __init__(self, html: str | None, known: Elements):
        self.blocks, self.children, self.parents = [], {0: []}, {}
        self.html, self.known = html or "", known
        self.stack = [("", 0, KEEP, False)]  # tag, path, role, inside an article
        self.texts, self.links, self.linked = [], 0, 0
        at = 0
        while True:
            found = TOKEN.search(self.html, at)
            if found is None:
                self.say(self.html[at:])
                break
            if found.start() > at:
                self.say(self.html[at:found.start()])
            at = found.end()
            opened = found[1] or found[4]
            if opened:
                at = self.open(opened.lower(), found[2] or found[5] or "", at)
            elif found[3]:
                self.close(found[3].lower())
        self.flush()

    def say(self, text: str) -> None:
        if self.stack[-1][0] in RAW:
            return
        if "&" in text:
            text = unescape(text)
        self.texts.append(text)
        if self.links:
            self.linked += len("".join(text.split()))

    def flush(self) -> None:
        """End the block."""
        text = " ".join("".join(self.texts).split())
        if text:
            _, path, role, article = self.stack[-1]
            self.blocks.append(Block(path, text, self.linked, role != KEEP, article))
        self.texts.clear()
        self.linked = 0

    def open(self, tag: str, attributes: str, at: int) -> int:
        if tag == "br":
            self.texts.append(" ")
            return at
        if tag in INLINE:
            if tag in VOID:
                return at
            label, role = self.known[tag, attributes]
            _, path, above, article = self.stack[-1]
            self.links += tag == "a"
            self.stack.append((tag, path, DROP if role == DROP else above, article))
            return at
        self.flush()
        if tag in CLOSES_P:
            self.close_to(("p",), ("table", "td", "th", "button", "object"))
        if tag in CLOSES:
            self.close_to(*CLOSES[tag])
        if tag in HEADINGS and self.stack[-1][0] in HEADINGS:
            self.pop(len(self.stack) - 1)
        if tag in VOID:
            return at
        label, role = self.known[tag, attributes]
        landmark = label.split(" ", 1)[0] in LANDMARKS
        if landmark:
            self.leave_unclosed(at)
        _, path, above, article = self.stack[-1]
        if landmark and role == KEEP and above != KEEP and self.only_forms():
            above = KEEP  # a form around the whole page
        article = article or landmark and role == KEEP and above == KEEP
        role = DROP if DROP in (role, above) else OUTSIDE_ONLY if OUTSIDE_ONLY in (role, above) and not article else KEEP
        here = path_of(path, label)
        beside = self.children[path]
        if not beside or beside[-1] != label:  # a row of the same elements is one
            beside.append(label)
        self.children.setdefault(here, [])
        self.parents[here] = path
        self.stack.append((tag, here, role, article))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.html, at)
            at = end.start() if end else len(self.html)
        return at

    def only_forms(self) -> bool:
        """All that is known against the open elements is that a form holds them."""
        return all(role != DROP or tag == "form" or self.stack[i - 1][2] == DROP
                   for i, (tag, _, role, _) in enumerate(self.stack))

    def leave_unclosed(self, at: int) -> None:
        """An article begins: dropped elements that the rest of the page never closes are over."""
        for depth, (tag, _, role, _) in enumerate(self.stack):
            if depth and role == DROP and not re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(self.html, at):
                self.pop(depth)
                return

    def above(self, path: int) -> list[int]:
        """The path and those of all elements around it."""
        found = [path]
        while path in self.parents:
            path = self.parents[path]
            found.append(path)
        return found

    def close_to(self, tags: tuple, fences: tuple) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth][0]
            if tag in tags:
                self.pop(depth)
                return
            if tag in fences or tag not in INLINE and tags == ("p",):
                return

    def close(self, tag: str) -> None:
        if tag == "br":
            self.texts.append(" ")
            return
        inline = tag in INLINE
        if not inline:
            self.flush()
        for depth in range(len(self.stack) - 1, 0, -1):
            other = self.stack[depth][0]
            if other == tag:
                self.pop(depth)
                return
            if inline and other not in INLINE:
                return

    def pop(self, depth: int) -> None:
        for tag, *_ in self.stack[depth:]:
            self.links -= tag == "a"
        del self.stack[depth:]
