"""A tree of a page, and its text again.

Tree rules (frozen by tests): elements have lower-case names; void elements have no content; script and style hold raw
text; a start tag closes what it ends by the table below, up to the nearest barrier; an end tag closes everything up
to the nearest open element of its name and is passed over without one; html, head and body are made if missing;
elements for the head before any body content go to the head.  Entities are decoded in text and attributes and
written back in the least form.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pagemill.contract import BLOCK, EXCLUDED, FLOW, STANDALONE, VOID
from pagemill.functions.protect import has_words

# Which open elements a start tag ends, and what stops the search for them.
_PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"),
    "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th"), "caption": ("caption",),
}
_BARRIERS = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",),
    "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "caption": ("table",),
}
_PARAGRAPH_BARRIERS = frozenset("table td th caption button object html body li dd dt div section article aside nav main header footer blockquote form fieldset figure details".split())
_HEAD = frozenset("base link meta noscript script style template title".split())
_RAW = frozenset(("script", "style"))


class Node:
    """An element, or with ``tag`` None a text, with "!" a comment or declaration (``text`` holds its markup)."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text, self.children, self.parent = tag, attrs or {}, text, [], None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    @property
    def element(self) -> bool:
        return self.tag is not None and self.tag != "!"

    def up(self) -> Iterator[Node]:
        """The node and its ancestors that are elements, nearest first."""
        node = self
        while node is not None and node.tag != "#root":
            if node.element:
                yield node
            node = node.parent

    def walk(self) -> Iterator[Node]:
        """The node and all below it in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def elements(self) -> list[Node]:
        return [n for n in self.children if n.element]


class _Builder(HTMLParser):
    def __init__(self, fragment: bool):
        super().__init__(convert_charrefs=True)
        self.root, self.fragment = Node("#root"), fragment
        self.at = self.root
        self.page: dict[str, Node] = {}

    def _made(self, name: str) -> Node:
        if name not in self.page:
            if name == "html":
                self.page[name] = self.root.add(Node("html"))
            else:
                self._made("html" if name == "head" else "head")
                self.page[name] = self.page["html"].add(Node(name))
        return self.page[name]

    def _close(self, names, barriers) -> None:
        for node in self.at.up():
            if node.tag in names:
                self.at = node.parent
                return
            if node.tag in barriers:
                return

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, "" if v is None else v)
        if not self.fragment:
            if tag in ("html", "head", "body"):
                node = self._made(tag)
                for k, v in own.items():
                    node.attrs.setdefault(k, v)
                self.at = node
                return
            if "body" not in self.page and self.at in (self.root, self.page.get("html"), self.page.get("head")):
                self.at = self._made("head" if tag in _HEAD else "body")
        if tag in _PARAGRAPH_ENDS:
            self._close(("p",), _PARAGRAPH_BARRIERS)
        for _ in range(3):
            if tag in _ENDS:
                before = self.at
                self._close(_ENDS[tag], _BARRIERS[tag])
                if self.at is before:
                    break
        node = self.at.add(Node(tag, own))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "head", "body"):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        if tag in ("html", "body") and not self.fragment:
            return
        for node in self.at.up():
            if node.tag == tag:
                self.at = node.parent or self.root
                return

    def handle_data(self, data):
        if not self.fragment and self.at in (self.root, self.page.get("html"), self.page.get("head")):
            if not data.strip():
                if self.at is self.page.get("head"):
                    self.at.add(Node(None, text=data))
                return
            self.at = self._made("body")
        last = self.at.children[-1] if self.at.children else None
        if last is not None and last.tag is None:
            last.text += data
        else:
            self.at.add(Node(None, text=data))

    def handle_comment(self, data):
        self.at.add(Node("!", text=f"<!--{data}-->"))

    def handle_decl(self, decl):
        self.at.add(Node("!", text=f"<!{decl}>"))

    def handle_pi(self, data):
        self.at.add(Node("!", text=f"<?{data}>"))


def parse(html: str, fragment: bool = False) -> Node:
    """The root of the tree; its children are the page's (or the fragment's) topmost nodes."""
    builder = _Builder(fragment)
    builder.feed(html)
    builder.close()
    if not fragment:
        builder._made("body")
    return builder.root


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def start_tag(node: Node) -> str:
    out = [node.tag]
    for k, v in node.attrs.items():
        v = escape(v)
        out.append(f'{k}="{v}"' if '"' not in v else f"{k}='{v}'" if "'" not in v else k + '="' + v.replace('"', "&quot;") + '"')
    return f"<{' '.join(out)}{'/' if node.tag in VOID else ''}>"


def serialize(node: Node, skip=lambda n: False) -> str:
    """Markup of a node; elements that ``skip`` names are left out with all they hold."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag is None:
            out.append(n.text if n.parent is not None and n.parent.tag in _RAW else escape(n.text))
        elif n.tag == "!":
            out.append(n.text)
        elif n is not node and skip(n):
            continue
        else:
            if n.tag != "#root":
                out.append(start_tag(n))
                if n.tag not in VOID:
                    todo.append(f"</{n.tag}>")
            todo.extend(reversed(n.children))
    return "".join(out)


def inner(node: Node, skip=lambda n: False) -> str:
    out = [serialize(c, skip) for c in node.children if not (c.element and skip(c))]
    return "".join(out)


def visible_text(node: Node) -> str:
    """Texts below a node, stripped and joined by a space."""
    return " ".join(t for n in node.walk() if n.tag is None and (n.parent is None or n.parent.tag not in _RAW) and (t := n.text.strip()))


def is_heading(tag: str) -> bool:
    return len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"


def candidate(node: Node) -> bool:
    """Neither the element nor one above it is excluded from translation."""
    return not any(n.tag in EXCLUDED or n.attrs.get("translate", "").strip().lower() == "no" for n in node.up())


def owner(text: Node) -> Node | None:
    """Whose text this is: the nearest block, else standalone element, else flow container, else the parent."""
    return _owner(text, [n for n in text.up() if candidate(n)])


def _owner(text: Node, above: list[Node]) -> Node | None:
    for names in (BLOCK, STANDALONE, FLOW):
        for n in above:
            if n.tag in names:
                return n
    return text.parent if text.parent is not None and text.parent.element else None


def content_owners(root: Node) -> set[int]:
    found = set()
    for n in root.walk():
        if n.tag is None and n.text.strip() and n.parent.element and candidate(n.parent) and has_words(n.text):
            own = _owner(n, list(n.up()))  # all above a candidate are candidates
            if own is not None:
                found.add(id(own))
    return found
