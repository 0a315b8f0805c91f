"""One parse of one page: a small tree, the main content as Markdown, and the raw metadata.

This is the row-level helper behind :mod:`gleanery.operators.extract`; Spark calls it on Arrow batches.  It knows
the parts of the HTML rules that saved pages need (implied end tags, raw text, re-opened formatting elements).  The
re-parenting that HTML asks for when formatting and block elements overlap at an end tag is left out: text keeps its
order there but may stay inside the formatting element.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.entities import html5 as _ENTITIES

from gleanery.constants import UNICODE_SPACE

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp".split())
ESCAPABLE_RAW = frozenset(("title", "textarea"))
HEAD_ONLY = frozenset("base link meta title script style noscript template".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
BLOCK = frozenset((
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header "
    "hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp dd dt"
).split()) | HEADINGS
SPECIAL = BLOCK | frozenset((
    "applet area base body br button caption col colgroup embed frame frameset head html iframe img input link "
    "marquee meta noembed noframes noscript object param script select source style tbody td template textarea tfoot "
    "th thead title tr track wbr"
).split())
SCOPE_LIMIT = frozenset("applet caption html body table td th marquee object template".split())
TABLE_LIMIT = frozenset(("table", "html", "body", "template"))
CELL = frozenset(("td", "th", "caption"))
UNREAD = frozenset("head script style noscript template iframe noembed noframes".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)
      | <(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)
        (?P<attrs>(?:[\s/]+|[^\s/>=][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?|=)*+)>
      | <[!?/][^>]*>?
      | (?P<text>[^<]+|<(?!/?[a-zA-Z]))""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
_ATTR_REF = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*)(;?)(=?))")
_NEWLINES = re.compile("\n{3,}")


class Node:
    __slots__ = ("tag", "attrs", "kids", "open")

    def __init__(self, tag, attrs=None):
        self.tag, self.attrs, self.kids, self.open = tag, attrs or {}, [], False


def _attr_value(value):
    if "&" not in value:
        return value

    def decode(ref):
        # In an attribute an entity without its semicolon counts only when nothing name-like follows.
        if ref[1] is None or ref[2]:
            return unescape(ref[0]) if not ref[3] else unescape(ref[0][:-1]) + "="
        return ref[0] if ref[3] or ref[1] not in _ENTITIES else _ENTITIES[ref[1]]

    return _ATTR_REF.sub(decode, value)


def _attributes(source):
    found = {}
    for match in _ATTR.finditer(source):
        found.setdefault(match[1].lower(), _attr_value(match[2] or match[3] or match[4] or ""))
    return found


class _Builder:
    def __init__(self):
        self.root, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.root.kids = [self.head, self.body]
        self.open = [self.root, self.body]
        self.open_tags = Counter(("html", "body"))
        self.formatting = []  # open formatting elements; None marks a table cell
        self.in_body = False

    # -- where things go ------------------------------------------------------
    def add(self, node, push=True):
        self.open[-1].kids.append(node)
        if push:
            node.open = True
            self.open.append(node)
            self.open_tags[node.tag] += 1

    def text(self, text):
        if not self.in_body:
            text = text.lstrip(" \t\n\f")
            if not text:
                return
            self.in_body = True
        if self.formatting:
            self.reopen()
        self.open[-1].kids.append(text)

    def reopen(self):
        """Formatting elements cut short by a block's end are opened again."""
        active = self.formatting
        first = len(active)
        while first and active[first - 1] is not None and not active[first - 1].open:
            first -= 1
        for i in range(first, len(active)):
            copy = Node(active[i].tag, active[i].attrs)
            self.add(copy)
            active[i] = copy

    def in_scope(self, tags, limit=SCOPE_LIMIT):
        if not any(self.open_tags[tag] for tag in tags):
            return False
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in limit:
                return False
        return False

    def close(self, tags):
        """Pop up to and including the nearest of ``tags``."""
        while len(self.open) > 2:
            node = self.pop()
            if node.tag in CELL:
                self.drop_marker()
            if node.tag in tags:
                return

    def pop(self, at=-1):
        node = self.open.pop(at)
        node.open = False
        self.open_tags[node.tag] -= 1
        return node

    def drop_marker(self):
        while self.formatting and self.formatting.pop() is not None:
            pass

    def close_p(self):
        if self.in_scope(("p",), SCOPE_LIMIT | {"button"}):
            self.close(("p",))

    # -- tags -------------------------------------------------------------------
    def start(self, tag, attrs):
        if tag in ("html", "head", "body"):
            self.in_body = self.in_body or tag == "body"
            return
        if not self.in_body:
            if tag in HEAD_ONLY:
                self.head.kids.append(Node(tag, attrs))
                return
            self.in_body = True
        if tag in BLOCK and tag != "li" and tag not in ("dd", "dt"):
            self.close_p()
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop()
        elif tag in ("li", "dd", "dt"):
            self.close_item(("li",) if tag == "li" else ("dd", "dt"))
        elif tag in ("option", "optgroup") and self.open[-1].tag == "option":
            self.pop()
        elif tag in CELL or tag in ("tr", "tbody", "thead", "tfoot"):
            ends = CELL if tag in CELL else CELL | {"tr"} if tag == "tr" else CELL | {"tr", "tbody", "thead", "tfoot"}
            while self.in_scope(ends, TABLE_LIMIT):
                self.close(ends)
        elif tag == "a":
            for node in reversed(self.formatting):
                if node is None:
                    break
                if node.tag == "a":
                    self.end_formatting(node)
                    break
        if tag not in SPECIAL or tag in ("br", "img", "embed", "input", "wbr", "area", "button", "select"):
            if self.formatting:
                self.reopen()
        node = Node(tag, attrs)
        self.add(node, tag not in VOID)
        if tag in CELL:
            self.formatting.append(None)
        elif tag in FORMATTING:
            alike = 0
            for i in range(len(self.formatting) - 1, -1, -1):
                other = self.formatting[i]
                if other is None:
                    break
                alike += other.tag == tag and other.attrs == attrs
                if alike == 3:
                    del self.formatting[i]
                    break
            self.formatting.append(node)

    def close_item(self, tags):
        for node in reversed(self.open):
            if node.tag in tags:
                self.close(tags)
                break
            if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                break
        self.close_p()

    def end_formatting(self, node):
        """Close one formatting element; blocks opened inside it stay open below their parent."""
        self.formatting.remove(node)
        if not node.open:
            return
        at = len(self.open) - 1
        block = False
        while self.open[at] is not node:
            block = block or self.open[at].tag in SPECIAL
            at -= 1
        if block:
            self.pop(at)
        else:
            while len(self.open) > at:
                self.pop()

    def end(self, tag):
        if not self.in_body or tag in ("html", "body"):
            return
        if tag == "p":
            if not self.in_scope(("p",), SCOPE_LIMIT | {"button"}):
                self.add(Node("p"))
            self.close(("p",))
        elif tag == "br":
            self.start("br", {})
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.close(HEADINGS)
        elif tag in FORMATTING:
            for node in reversed(self.formatting):
                if node is None:
                    break
                if node.tag == tag:
                    self.end_formatting(node)
                    return
            self.end_other(tag)
        elif tag == "li":
            if self.in_scope(("li",), SCOPE_LIMIT | {"ol", "ul"}):
                self.close(("li",))
        elif tag in CELL or tag in ("tr", "tbody", "thead", "tfoot", "table"):
            if self.in_scope((tag,), TABLE_LIMIT - {tag}):
                self.close((tag,))
        elif tag in SPECIAL:
            if self.in_scope((tag,), SCOPE_LIMIT - {tag}):
                self.close((tag,))
        else:
            self.end_other(tag)

    def end_other(self, tag):
        for node in reversed(self.open):
            if node.tag == tag:
                self.close((tag,))
                return
            if node.tag in SPECIAL:
                return


def parse(html):
    """The tree of a page."""
    builder = _Builder()
    html = html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    position, size = 0, len(html)
    swallow_newline = False
    while position < size:
        match = _TOKEN.match(html, position)
        if match is None:  # a tag that is never closed ends the page
            break
        position = match.end()
        text = match["text"]
        if text is not None:
            if swallow_newline and text[0] == "\n":
                text = text[1:]
            swallow_newline = False
            if text:
                builder.text(unescape(text) if "&" in text else text)
            continue
        swallow_newline = False
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if match["end"]:
            builder.end(name)
            continue
        source = match["attrs"]
        builder.start("img" if name == "image" else name, _attributes(source) if source else {})
        if name in RAW or name in ESCAPABLE_RAW:
            stop = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, position)
            raw = html[position:stop.start() if stop else size]
            position = html.find(">", stop.end()) + 1 or size if stop else size
            owner = builder.open[-1] if builder.in_body else builder.head.kids[-1]
            if raw:
                owner.kids.append(unescape(raw) if name in ESCAPABLE_RAW and "&" in raw else raw)
            if builder.in_body and owner.tag == name and len(builder.open) > 2:
                builder.pop()
        swallow_newline = name in ("pre", "listing")
    return builder.root


def _text_of(node, everything):
    parts, todo = [], [node]
    while todo:
        item = todo.pop()
        if type(item) is str:
            parts.append(item)
        elif everything or item.tag not in UNREAD:
            todo.extend(reversed(item.kids))
    return "".join(parts)


def _write(node, out, bare):
    """Markdown of the children of ``node``.  What is still to be written waits on a list, so depth costs no stack.

    The list holds nodes, text to write as it is, and ``(kids, bare, breaks)`` of an opened element.
    """
    todo = [_opened(node, False)]
    while todo:
        step = todo[-1]
        if type(step) is str:
            todo.pop()
            out.append(step)
            continue
        kid = next(step[0], None)
        if kid is None:
            todo.pop()
        elif type(kid) is str:
            if bare:
                out.append(kid)
        elif step[1] and kid.tag in ("br", "hr"):
            out.append("\n")
        else:
            _write_element(kid, out, bare, todo)


def _opened(node, breaks):
    return iter(node.kids), breaks


def _write_element(node, out, bare, todo):
    """Write one element, or put its parts on ``todo``, the last first."""
    tag = node.tag
    if bare and tag in UNREAD:
        return
    inner = None if tag not in _FLAT else _text_of(node, not bare)
    if tag in HEADINGS:
        out.append(f"{'#' * int(tag[1])} {inner}\n\n")
    elif tag in ("p", "div"):
        todo += ["\n\n", _opened(node, True)]
    elif tag == "br":
        out.append("\n")
    elif tag == "hr":
        out.append("\n---\n")
    elif tag in _EMPHASIS:
        mark = _EMPHASIS[tag]
        out.append(f"{mark}{inner}{mark}")
    elif tag == "a":
        href = node.attrs.get("href")
        out.append(f"[{inner}]({href})" if href and inner else inner)
    elif tag == "img":
        src = node.attrs.get("data-src") or node.attrs.get("src")
        if src:
            out.append(f"![{node.attrs.get('alt', '')}]({src})")
    elif tag in ("ul", "ol"):
        items = [kid for kid in node.kids if type(kid) is not str and kid.tag == "li"]
        parts = []
        for number, item in enumerate(items, start=1):
            parts += ["- " if tag == "ul" else f"{number}. ", _opened(item, False), "\n"]
        todo += reversed([*parts, "\n"])
    elif tag == "pre":
        out.append(f"```\n{inner}\n```\n\n")
    elif tag == "blockquote":
        out.extend(f"> {line}\n" if line else "\n" for line in inner.split("\n"))
        out.append("\n")
    else:
        todo.append(_opened(node, False))


_EMPHASIS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
_FLAT = HEADINGS | frozenset(_EMPHASIS) | {"a", "pre", "blockquote"}


def markdown(node, max_bytes, bare=True):
    """The children of ``node`` as Markdown of at most ``max_bytes`` bytes (0: no limit)."""
    out = []
    _write(node, out, bare)
    text = _NEWLINES.sub("\n\n", "".join(out)).strip(UNICODE_SPACE)
    if max_bytes > 0 and len(text) * 4 > max_bytes:
        raw = text.encode("utf-8", "replace")
        if len(raw) > max_bytes:
            text = raw[:max_bytes].decode("utf-8", "ignore")
    return text


def _selector_test(selector):
    match = re.fullmatch(r"\[([\w-]+)='([^']*)'\]|([\w-]*)(?:#([\w-]+)|\.([\w-]+))?", selector)
    attr, value, tag, ident, cls = match.groups()

    def test(node):
        if attr:
            return node.attrs.get(attr) == value
        return (
            (not tag or node.tag == tag)
            and (not ident or node.attrs.get("id") == ident)
            and (not cls or cls in node.attrs.get("class", "").split())
        )

    return test


class PageReader:
    """Reads pages with a fixed list of selectors."""

    def __init__(self, selectors, extra_selectors, fallback, min_bytes, max_bytes, bare):
        self.common = [(s, _selector_test(s)) for s in selectors]
        self.extra = [(s, _selector_test(s)) for s in extra_selectors] + self.common
        self.fallback, self.min_bytes, self.max_bytes, self.bare = fallback, min_bytes, max_bytes, bare

    def read(self, html, use_extra=False):
        """``(content, selector, metadata)`` of one page; the metadata values are as written in the page."""
        root = parse(html)
        tests = self.extra if use_extra else self.common
        found, props, names, titles = {}, {}, {}, []
        canonical = ""
        todo = [root]
        while todo:
            node = todo.pop()
            if type(node) is str:
                continue
            todo.extend(reversed(node.kids))
            attrs = node.attrs
            if attrs or node.tag in ("article", "main"):
                for name, test in tests:
                    if name not in found and test(node):
                        found[name] = node
            if node.tag == "meta":
                content = attrs.get("content")
                if content:
                    if "property" in attrs:
                        props.setdefault(attrs["property"], content)
                    if "name" in attrs:
                        names.setdefault(attrs["name"], content)
            elif node.tag == "link":
                if not canonical and attrs.get("rel") == "canonical":
                    canonical = attrs.get("href", "")
            elif node.tag == "title":
                titles.append(_text_of(node, True))
        metadata = (
            canonical,
            props.get("og:title") or "".join(titles).strip(UNICODE_SPACE),
            props.get("og:description") or names.get("description", ""),
            props.get("og:image", ""),
            props.get("article:author", ""),
            props.get("article:published_time", ""),
            props.get("og:site_name") or names.get("", ""),
        )
        for name, _ in tests:
            node = found.get(name)
            if node is not None and node.kids:
                content = markdown(node, self.max_bytes, self.bare)
                if len(content.encode("utf-8", "replace")) >= self.min_bytes:
                    return content, name, metadata
        return markdown(root, self.max_bytes, self.bare), self.fallback, metadata
