"""Visible text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer of blocks, lists and tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from unicodedata import category, combining, east_asian_width

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes datalist object audio video canvas area base link meta param rp".split())
#: In svg and math: elements that show nothing, and those whose text shows.
FOREIGN_HIDDEN = frozenset("annotation annotation-xml defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter mphantom".split())
FOREIGN_TEXT = frozenset("text foreignobject mi mo mn ms mtext".split())
#: HTML elements that end svg and math.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table ul search select".split())
LISTS = frozenset("ul ol menu dir".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote table figure hr fieldset".split())
#: What an opening tag closes, up to the nearest of the scope's elements.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
    "a": ({"a"}, {"td", "th", "table"}),
}
#: Opening one of these closes an open paragraph.
ENDS_P = BLOCK - {"body", "html", "legend", "option", "optgroup", "select", "li", "dd", "dt"} | {"li", "dd", "dt"}
#: An end tag looks no further up than these.
BARRIERS = frozenset("table td th caption html".split())
#: Elements whose end tag doesn't end a block that was opened inside them.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Lists and other blocks are indented by so many levels at most; deeper ones show at that level.
LEVELS = 40

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?=[^a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[\s/]++|=?[^\s/<>=]++(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s<>\"'][^\s<>]*+)?+)?+)*+)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"(=?[^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_NOISE = re.compile(rf"/\*.*?(?:\*/|\Z)|{_STRING}|<!--|-->", re.S)
_PIECE = re.compile(rf"(?:{_STRING}|[^{{}};])*+(?:[{{}};]|\Z)", re.S)
_COMMAS = re.compile(rf"(?:{_STRING}|\([^()]*\)|[^,])++")
_SHOWS = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*\Z", re.I)
_SCREEN = re.compile(r"\s*(?:(?:only\s+)?(?:all|screen))?\s*\Z", re.I)
_SELECTOR = re.compile(r"\s*([>+~]|\s)\s*|([a-z][\w-]*|\*)|([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?)=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*(i?)\s*)?\]", re.I)


class Node:
    """An element; children are nodes and strings in order."""

    __slots__ = ("attributes", "children", "classes", "declared", "depth", "foreign", "parent", "shown", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.depth, self.shown, self.declared = parent.depth + 1 if parent else 0, True, []
        self.classes = frozenset(attributes.get("class", "").split())
        within = parent is not None and parent.foreign  # "no" in svg and math where no text shows, "text" in svg text
        self.foreign = "" if tag in FOREIGN_TEXT - {"text"} or tag == "annotation-xml" else "text" if within and tag == "text" else within or ("no" if tag in ("svg", "math") else "")


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


class Builder:
    """The tree in progress. ``node`` and its ancestors are open; ``at`` has them by name, outermost first.

    Looking for an open element costs the same at any depth, so pages nested however deep take linear time.
    """

    def __init__(self) -> None:
        self.root = self.node = Node("", {}, None)
        self.at: dict[str, list[Node]] = {}

    def add(self, tag: str, attributes: dict[str, str]) -> Node:
        new = Node(tag, attributes, self.node)
        self.node.children.append(new)
        return new

    def open(self, node: Node) -> None:
        self.node = node
        self.at.setdefault(node.tag, []).append(node)

    def leave(self, until: Node) -> None:
        """Close the open elements up to ``until``, itself included."""
        while True:
            last = self.node
            self.at[last.tag].pop()
            self.node = last.parent
            if last is until:
                return

    def inner(self, names) -> int:
        """Depth of the innermost open element of ``names``; 0: none."""
        return max((self.at[n][-1].depth for n in names if self.at.get(n)), default=0)

    def close(self, names, scope) -> None:
        """Close the outermost open element of ``names`` that lies within ``scope``."""
        found, floor = None, None
        for name in names:
            for node in reversed(self.at.get(name, ())):
                floor = self.inner(scope) if floor is None else floor
                if node.depth <= floor:
                    break
                if found is None or node.depth < found.depth:
                    found = node
        if found is not None:
            self.leave(found)

    def end(self, name: str) -> None:
        """An end tag: closes the innermost element of its name, unless a table or cell stands between."""
        free = name in BARRIERS or name in ("tr", "tbody", "thead", "tfoot", "body")
        for _ in range(8):  # fixed by the HTML standard: so many blocks are taken out of a formatting element
            if not self.at.get(name) or not free and self.at[name][-1].depth < self.inner(BARRIERS):
                return
            found = self.at[name][-1]
            if name not in FORMATTING or not self.take_out(found):
                self.leave(found)
                return

    def take_out(self, formatting: Node) -> bool:
        """Move the outermost open block inside a formatting element out behind it; whether there is one.

        The block stays open and its content so far keeps the formatting in a copy, what follows doesn't. Of the formatting
        elements between the two, the three next to the block are copied around it (fixed by the HTML standard).
        """
        between: list[Node] = []
        block, node = None, self.node
        while node is not formatting:
            if node.tag in BLOCK or node.tag in BARRIERS:
                block, between = node, []
            elif block is not None:
                between.append(node)
            node = node.parent
        if block is None:
            return False
        block.parent.children.pop()  # an open element is its parent's last child
        parent = formatting.parent
        kept = [n for n in between[:3] if n.tag in FORMATTING]
        for old in between:
            if old not in kept:
                self.at[old.tag].remove(old)
        for old in reversed(kept):
            copy = Node(old.tag, old.attributes, parent)
            parent.children.append(copy)
            self.at[old.tag][self.at[old.tag].index(old)] = parent = copy
        block.parent, block.depth = parent, parent.depth + 1
        parent.children.append(block)
        copy = Node(formatting.tag, formatting.attributes, block)
        copy.children, block.children = block.children, [copy]
        for child in copy.children:
            if isinstance(child, Node):
                child.parent = copy
        self.at[formatting.tag][-1] = copy
        if self.node is block:
            self.node = copy
        return True


def tree(html: str) -> tuple[Node, list[str]]:
    """The page's elements below a root, end tags and containers implied, and the text of its style sheets."""
    build = Builder()
    styles: list[str] = []
    at = 0
    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        end, name = m[1], m[2]
        if name is None:
            if not m[0].startswith(("<!", "<?", "</")) or m[0] == "</":
                build.node.children.append(unescape(m[0]))
            continue
        name = name.lower()
        if end:
            if name in ("p", "br") and build.inner([name]) <= build.inner(BARRIERS):  # </p> alone makes an empty paragraph, </br> a break
                build.add(name, {})
            else:
                build.end(name)
            continue
        if build.node.foreign and name in BREAKOUT:
            while build.node.foreign:
                build.leave(build.node)
        if name in ENDS_P:
            build.close({"p"}, {"table", "td", "th", "button"})
        if name in CLOSES:
            build.close(*CLOSES[name])
        if name in ("td", "th") and build.node.tag in ("table", "tbody", "thead", "tfoot"):
            build.open(build.add("tr", {}))
        within = build.node.foreign
        new = build.add(name, attributes_of(m[3]) if m[3] else {})
        if name in RAW or name in RCDATA:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            text = html[at : stop.start() if stop else len(html)]
            at = stop.end() if stop else len(html)
            if name == "style":
                if screen(new.attributes.get("media", "")):
                    styles.append(text)
            elif name in RCDATA:
                new.children.append(unescape(text))
        elif name not in VOID and not ((within or new.foreign) and m[3].endswith("/")):
            build.open(new)
    return build.root, styles


def screen(media: str) -> bool:
    """Whether a media list holds for screens without a condition."""
    return any(_SCREEN.match(m) for m in media.split(","))


#: Whether a value hides; None: as the parent. Other values of visibility are no values.
_VISIBILITY = {"visible": False, "initial": False, "hidden": True, "collapse": True, "inherit": None, "unset": None}


def declared(text: str) -> list[tuple[str, bool | None, bool]]:
    """(property, whether it hides, whether important) of the display and visibility declarations."""
    out = []
    for m in (_SHOWS.match(d) for d in _NOISE.sub(" ", text).split(";")):
        if m and m[1].lower() == "display":
            out.append(("display", m[2].lower() == "none", bool(m[3])))
        elif m and m[2].lower() in _VISIBILITY:
            out.append(("visibility", _VISIBILITY[m[2].lower()], bool(m[3])))
    return out


def selector_of(text: str) -> tuple[tuple, list] | None:
    """(specificity, parts in order) of a selector; None where it has pseudo-classes or other things that aren't known.

    A part is (combinator to the part before it, element name, classes, ids, attributes).
    """
    parts: list[list] = [["", "", set(), set(), []]]
    text, at, ids, marks, tags = text.strip(), 0, 0, 0, 0
    while at < len(text):
        m = _SELECTOR.match(text, at)
        if not m:
            return None
        at = m.end()
        part = parts[-1]
        if m[1]:
            if part[1:] == ["", set(), set(), []]:
                return None
            parts.append([m[1] if m[1] in ">+~" else " ", "", set(), set(), []])
        elif m[2]:
            part[1], tags = m[2].lower(), tags + (m[2] != "*")
        elif m[3]:
            part[2 if m[3] == "." else 3].add(m[4])
            ids, marks = ids + (m[3] == "#"), marks + (m[3] == ".")
        else:
            part[4].append((m[5].lower(), m[6], next((x for x in m.group(7, 8, 9) if x is not None), None), bool(m[10])))
            marks += 1
    return ((ids, marks, tags), parts) if parts[-1][1:] != ["", set(), set(), []] else None


def holds(attributes: dict[str, str], name: str, how: str, value: str | None, fold: bool) -> bool:
    """Whether an attribute condition of a selector holds."""
    has = attributes.get(name)
    if has is None or value is None:
        return has is not None
    if fold:
        has, value = has.lower(), value.lower()
    if how in ("^", "$", "*", "~") and not value:
        return False
    return {"": has == value, "~": value in has.split(), "|": has == value or has.startswith(value + "-"), "^": has.startswith(value), "$": has.endswith(value), "*": value in has}[how]


def declare(root: Node, rules: list[tuple]) -> None:
    """Give each element the declarations of the rules that match it, weakest first.

    One walk in document order. Bit n of a mask stands for the n-th part of all selectors: an element has it if the part
    takes it and the parts before it match as their combinators ask. So the cost doesn't depend on the depth.
    """
    parts: list[tuple] = []
    last: dict[int, tuple] = {}
    for order, (weight, selector, prop, hides) in enumerate(rules):
        parts += [(part, len(parts) + i) for i, part in enumerate(selector)]
        last[len(parts) - 1] = (order, weight, prop, hides)
    wanted: dict[tuple[str, str], list] = {}
    for part, n in parts:
        key = ("#", min(part[3])) if part[3] else (".", min(part[2])) if part[2] else ("", part[1] if part[1] != "*" else "")
        wanted.setdefault(key, []).append((part, n))
    masks: dict[int, tuple[int, int]] = {id(root): (0, 0)}  # of an element: its own parts, and those of it and all above
    walk: list[tuple[Node, list]] = [(root, [0, 0, iter(root.children)])]  # with the parts of the child before, and of all before
    while walk and parts:
        node, state = walk[-1]
        child = next((c for c in state[2] if isinstance(c, Node)), None)
        if child is None:
            walk.pop()
            continue
        own, above = masks[id(node)]
        bits, found = 0, []
        keys = [("", ""), ("", child.tag), ("#", child.attributes.get("id", "")), *((".", c) for c in child.classes)]
        for (combinator, tag, classes, ids, conditions), n in (x for key in dict.fromkeys(keys) for x in wanted.get(key, ())):
            before = {"": -1, " ": above, ">": own, "+": state[0], "~": state[1]}[combinator]
            if combinator and not before >> (n - 1) & 1 or tag not in ("", "*", child.tag) or not classes <= child.classes or not ids <= {child.attributes.get("id")}:
                continue
            if all(holds(child.attributes, *c) for c in conditions):
                bits |= 1 << n
                if n in last:
                    found.append(last[n])
        child.declared = [f[1:] for f in sorted(found)]
        masks[id(child)] = bits, above | bits
        state[0], state[1] = bits, state[1] | bits
        walk.append((child, [0, 0, iter(child.children)]))


def hidden_by(styles: list[str]) -> list[tuple]:
    """Rules on display and visibility, weakest first: ((important, specificity), selector, property, hides).

    Blocks of at-rules count only for plain screens or all media, as a condition may not hold; nested rules don't count,
    nor do selectors with pseudo-classes or pseudo-elements.
    """
    out = []
    for style in styles:
        stack: list = [None]  # None: rules count here; False: nothing does; else the selectors of the rule
        for piece in _PIECE.findall(_NOISE.sub(lambda m: m[0] if m[0][0] in "\"'" else " ", style)):
            text, mark = (piece[:-1], piece[-1]) if piece[-1:] in ("{", "}", ";") and piece else (piece, "")
            top = stack[-1]
            if mark == "{":
                name = text.strip()
                media = re.match(r"@media(?![\w-])(.*)\Z", name, re.I | re.S)
                stack.append(False if top is not None else (None if media and screen(media[1]) else False) if name.startswith("@") else _COMMAS.findall(name))
                continue
            for prop, hides, important in declared(text) if top else []:
                for selector in map(selector_of, top):
                    if selector:
                        out.append(((important, selector[0]), selector[1], prop, hides))
            if mark == "}" and len(stack) > 1:
                stack.pop()
    return sorted(out, key=lambda r: r[0])


def visible(node: Node) -> bool:
    """Whether an element is laid out; sets whether its own text shows, which its content takes over.

    The last matching declaration of each property decides, the inline ones after the sheets'.
    """
    a = node.attributes
    node.shown = node.parent is None or node.parent.shown
    if node.tag in HIDDEN or node.foreign and node.tag in FOREIGN_HIDDEN or node.tag == "annotation-xml" or node.tag == "input" and not label(node):
        return False
    state = {"display": ((False, False), "hidden" in a or node.tag == "dialog" and "open" not in a)}
    found = [((important, False), prop, hides) for (important, _), prop, hides in node.declared]
    found += [((important, True), prop, hides) for prop, hides, important in declared(a.get("style", ""))]
    for weight, prop, hides in found:
        if weight >= state.get(prop, (weight,))[0]:
            state[prop] = weight, hides
    hidden = state.get("visibility", (None, None))[1]
    if hidden is not None:
        node.shown = not hidden
    return not state["display"][1]


def label(node: Node) -> str:
    """What a button made by an input element says."""
    kind = node.attributes.get("type", "").strip().lower()
    return node.attributes.get("value", {"submit": "Submit", "reset": "Reset"}.get(kind, "")) if kind in ("submit", "reset", "button") else ""


def width_of(text: str) -> int:
    """Columns that a line takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) or category(c) in ("Mn", "Me", "Cf") else 2 if east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Text laid out in lines: white space collapses, blocks start new lines, spaced blocks leave one blank line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.gap, self.space, self.marker = "", 0, False, ""

    def text(self, text: str) -> None:
        for i, word in enumerate(re.split(r"[ \t\n\r\f]+", text)):
            self.space |= i > 0
            if word:
                self._open()
                self.line += (" " if self.space and self.line.strip() and not self.line.endswith(" ") else "") + word
                self.space = False

    def _open(self) -> None:
        if self.lines and self.gap > 1 and not self.line:
            self.lines.append("")
        self.gap = 0
        if self.marker:
            self.line, self.marker = self.line + self.marker, ""

    def end(self, gap: int = 1) -> None:
        """End the line; what follows starts after ``gap`` - 1 blank lines."""
        if self.line:
            self.lines.append(self.line.rstrip())
        self.line, self.space, self.gap = "", False, max(self.gap, gap)

    def add(self, lines: list[str]) -> None:
        """Lines as they are."""
        for line in lines:
            self._open()
            self.lines.append((self.line + line).rstrip())
            self.line = ""

    def done(self) -> list[str]:
        self.end()
        return self.lines


def span(value: str | None, most: int) -> int:
    return min(most, max(1, int(value))) if value and value.isascii() and value.isdigit() else 1


def whole(value: str | None, otherwise: int) -> int:
    """An attribute as a whole number."""
    return int(value) if value and re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", value, re.A) else otherwise


def first(node: Node) -> list[int]:
    """Number before the first item of an ordered list, and the step."""
    if "reversed" not in node.attributes:
        return [whole(node.attributes.get("start"), 1) - 1, 1]
    items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
    return [whole(node.attributes.get("start"), items) + 1, -1]


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows they take) as text columns of equal width, two spaces apart."""
    grid: list[dict[int, list[str]]] = []
    taken: dict[tuple[int, int], bool] = {}
    for r, row in enumerate(rows):
        cells, c = {}, 0
        for lines, across, down in row:
            while (r, c) in taken:
                c += 1
            cells[c] = lines
            for k in range(r, min(len(rows), r + down)):
                for j in range(c, c + across):
                    taken[k, j] = True
            c += across
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for c, lines in cells.items():
            width[c] = max(width.get(c, 0), *(width_of(x) for x in lines or [""]))
    columns = sorted(width)
    out = []
    for cells in grid:
        for k in range(max([len(x) for x in cells.values()] or [0])):
            own = [(cells.get(c, []) + [""] * (k + 1))[k] for c in columns]
            out.append("  ".join(x + " " * (width[c] - width_of(x)) for c, x in zip(columns, own)).rstrip())
    return out


def rendered(html: str) -> str:
    """All visible text of a page."""
    root, styles = tree(html)
    declare(root, hidden_by(styles))
    contexts: list[tuple[Lines, list]] = [(Lines(), [])]  # the lines in progress, and a table's rows
    lists: list = []  # open lists and preformatted blocks: None, "pre", or [last number, step]
    depth = 0  # of the lists among them
    steps: list[tuple[str, object]] = [("in", root)]
    while steps:
        step, item = steps.pop()
        lines = contexts[-1][0]
        if step == "text":
            if len(lists) > depth:
                parts = item.replace("\r\n", "\n").split("\n")
                for i, part in enumerate(parts):
                    if i:
                        lines.add([""]) if not lines.line else lines.end()
                    if part:
                        lines._open()
                        lines.line += part
            else:
                lines.text(item)
            continue
        node: Node = item
        tag = node.tag
        gap = 2 if tag in SPACED and not (tag in LISTS and depth > (step == "out")) else 1
        if step == "in":
            if tag == "br":
                lines.end() if lines.line else lines.add([""])
                continue
            if tag and not visible(node):
                continue
            if tag == "input":
                if node.shown:
                    lines.text(label(node))
                continue
            if node.foreign or tag in FOREIGN_TEXT:
                lines.space |= tag == "text" or node.parent is not None and node.parent.tag in ("mfrac", "mtr", "mroot")
            if tag == "hr":
                lines.end(2)
                if node.shown:
                    lines.add(["---"])
                lines.end(2)
                continue
            if tag in BLOCK and tag not in ("td", "th"):
                lines.end(gap)
            if tag in LISTS:
                lists.append(first(node) if tag == "ol" else None)
                depth += 1
            elif tag == "pre":
                lists.append("pre")
            elif tag == "li":
                mark = "- "
                if lists and isinstance(lists[-1], list):
                    lists[-1][0] = whole(node.attributes.get("value"), lists[-1][0] + lists[-1][1])
                    mark = f"{lists[-1][0]}. "
                lines.marker = "  " * min(LEVELS, max(0, depth - 1)) + mark if node.shown else ""
            elif tag == "dd":
                lines.marker = "  "
            elif tag == "table":
                contexts.append((Lines(), []))
            elif tag == "tr" and len(contexts) > 1:
                contexts[-1][1].append([])
            elif tag in ("td", "th") and len(contexts) > 1:
                contexts.append((Lines(), None))
            steps.append(("out", node))
            closed = tag == "details" and "open" not in node.attributes
            for child in reversed(node.children):
                if closed and (isinstance(child, str) or child.tag != "summary") or isinstance(child, str) and (node.foreign == "no" or not node.shown):
                    continue
                steps.append(("text", child) if isinstance(child, str) else ("in", child))
        else:
            if tag in ("td", "th") and contexts[-1][1] is None:
                cell = contexts.pop()[0].done()
                rows = contexts[-1][1]
                if not rows:
                    rows.append([])
                rows[-1].append((cell, span(node.attributes.get("colspan"), 1000), span(node.attributes.get("rowspan"), 65534)))
            elif tag == "table" and len(contexts) > 1:
                loose, rows = contexts.pop()
                lines = contexts[-1][0]
                lines.end(2)
                lines.add(loose.done())  # captions, and text that stood between cells
                lines.add(table_lines(rows))
            if (tag in LISTS or tag == "pre") and lists:
                lists.pop()
                depth -= tag in LISTS
            if tag == "li":
                lines.marker = ""
            if tag in BLOCK:
                lines.end(gap)
    return "\n".join(contexts[0][0].done()).strip("\n")


def html_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html`` in ``text``.

    Pages are independent, so there is no shuffle. A null page has null text; an empty one, or one with nothing visible,
    an empty text; broken markup is read as far as it goes, at any depth, and what isn't a tag is text. An end tag of
    bold, links and the like leaves blocks that opened inside them open; such elements aren't opened anew after a block that
    ended them. Lists are indented by ``LEVELS`` levels at most. Other columns pass through,
    one named ``text`` before is replaced; repeated rows give equal rows.
    """

    @F.pandas_udf("string")
    def render(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda h: None if h is None else rendered(h))

    return pages.withColumn(text, render(F.col(html)))


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    pages = html_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return pages.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
