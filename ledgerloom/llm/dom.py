"""A forgiving DOM of HTML texts, and the alignment of two trees by simple tree matching (Yang, 1991)."""

from __future__ import annotations

import html as entities
import re

import numpy as np

#: Fixed values of HTML: elements without an end, those whose content is no markup, those inside a line, and which start tags
#: end which open elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math meter output q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Open elements that an implied end doesn't reach through.
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "body": set()}

_TOKEN = re.compile(
    r"""<(?:!--(?P<note>.*?)(?:-->|\Z) | (?P<end>/)?(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | /?[A-Za-z][^>]*+> | [!?/][^>]*+(?:>|\Z) | (?P<cut>/?[A-Za-z][^>]*+\Z))""",
    re.X | re.S,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NUMBER = re.compile(r"\d+")


class Node:
    """An element: ``kids`` are elements and decoded texts in order, ``inner`` the elements; ``name`` is the tag with its class, digits
    left out; ``shape`` numbers equal structures, ``value`` hashes the text."""

    __slots__ = ("tag", "attrs", "kids", "inner", "name", "shape", "value", "number")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids, self.inner = tag, attrs, [], []


def parse(html: str) -> Node:
    """The tree of a text, whatever it holds; comments, declarations and a tag that the end cuts off leave nothing."""
    root = Node("#root")
    stack, open_tags = [root], ["#root"]
    kids, at, size = root.kids, 0, len(html)
    find = _TOKEN.search
    while at < size:
        m = find(html, at)
        start = m.start() if m else size
        if start > at:
            text = html[at:start]
            if not text.isspace():
                kids.append(entities.unescape(text) if "&" in text else text)
            elif kids:
                kids.append(" ")
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in open_tags:
                last = len(open_tags) - 1
                to = last
                while open_tags[to] != tag:
                    to -= 1
                if to and (to == last or tag not in INLINE or all(t in INLINE for t in open_tags[to:])):
                    del stack[to:], open_tags[to:]
                    kids = stack[-1].kids
            continue
        held = m["attrs"]
        if tag == "p" or tag not in INLINE and tag not in VOID:
            ended = ENDS.get(tag)
            if ended:
                wall = WALLS[tag]
                for to in range(len(open_tags) - 1, 0, -1):
                    if open_tags[to] in wall:
                        break
                    if open_tags[to] in ended:
                        del stack[to:], open_tags[to:]
                        break
            elif "p" in open_tags:
                to = len(open_tags) - 1
                while open_tags[to] != "p":
                    to -= 1
                if all(t in INLINE for t in open_tags[to + 1 :]):
                    del stack[to:], open_tags[to:]
            kids = stack[-1].kids
        node = Node(tag, {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(held)} if held and not held.isspace() else None)
        kids.append(node)
        stack[-1].inner.append(node)
        if tag in VOID or held.endswith("/") and tag not in RAW and tag in ("svg", "path", "use", "circle", "rect"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            to = end.start() if end else size
            if to > at and tag in ("title", "textarea"):
                node.kids.append(entities.unescape(html[at:to]))
            at = end.end() if end else size
            continue
        stack.append(node)
        open_tags.append(tag)
        kids = node.kids
    return root


class Shapes:
    """Numbers of structures, and the scores of their matching, kept for one pair of trees or more."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.scores: dict[tuple[int, int], int] = {}

    def mark(self, root: Node) -> list[Node]:
        """All elements in document order, numbered, with name, shape and value."""
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            node.number = len(order)
            order.append(node)
            if node.inner:
                stack += node.inner[::-1]
        for node in reversed(order):
            values = []
            for k in node.kids:
                if k.__class__ is Node:
                    if k.value:
                        values.append(k.value)
                elif text := k.strip():
                    values.append(text)
            attrs = node.attrs
            node.name = node.tag if not attrs or "class" not in attrs else f"{node.tag}.{_NUMBER.sub('', attrs['class'] or '')}"
            key = (node.name, *[k.shape for k in node.inner])
            node.shape = self.known.setdefault(key, len(self.known))
            if node.shape == len(self.parts):
                self.parts.append(key)
            node.value = 0 if not values or node.tag in RAW else hash(tuple(values)) or 1
        return order

    def score(self, x: int, y: int) -> int:
        """Elements in the largest matching of two structures; 0 if their roots differ in name. Without recursion, as trees may be deep."""
        found = self.scores
        stack = [(x, y)]
        while stack:
            a, b = stack[-1]
            if (a, b) in found:
                stack.pop()
                continue
            p, q = self.parts[a], self.parts[b]
            if p[0] != q[0]:
                found[a, b] = 0
            elif a == b:
                found[a, b] = self._whole(a)
            else:
                need = [(i, j) for i in set(p[1:]) for j in set(q[1:]) if (i, j) not in found]
                if need:
                    stack += need
                    continue
                found[a, b] = 1 + int(_last_row(self.weights(p[1:], q[1:]))[-1])
            stack.pop()
        return found[x, y]

    def _whole(self, shape: int) -> int:
        total, stack = 0, [shape]
        while stack:
            kids = self.parts[stack.pop()][1:]
            total += 1
            stack += kids
        return total

    def weights(self, p: tuple, q: tuple) -> np.ndarray:
        if len(p) * len(q) <= 64:
            return np.array([[self.scores[i, j] if (i, j) in self.scores else self.score(i, j) for j in q] for i in p], np.int32).reshape(len(p), len(q))
        a, ia = np.unique(p, return_inverse=True)
        b, ib = np.unique(q, return_inverse=True)
        table = np.array([[self.scores[i, j] if (i, j) in self.scores else self.score(i, j) for j in b.tolist()] for i in a.tolist()], np.int32).reshape(len(a), len(b))
        return table[ia][:, ib] if len(p) and len(q) else np.zeros((len(p), len(q)), np.int32)


def _rows(weights: np.ndarray) -> np.ndarray:
    """The table of best sums over prefixes."""
    m, n = weights.shape
    best = np.zeros((m + 1, n + 1), np.int32)
    for i in range(m):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + weights[i]), out=best[i + 1, 1:])
    return best


def _last_row(weights: np.ndarray) -> np.ndarray:
    best = np.zeros(weights.shape[1] + 1, np.int32)
    for row in weights:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row))
    return best


#: Cells of a table of prefixes that are held at once; larger ones are halved (Hirschberg, 1975).
CELLS = 1 << 22


def sequence_pairs(shapes: Shapes, p: tuple, q: tuple) -> list[tuple[int, int]]:
    """Places of the best matching in order of two lists of structures."""
    found, stack = [], [(0, len(p), 0, len(q))]
    while stack:
        a, b, c, d = stack.pop()
        # What is alike at both ends is matched by some best matching.
        while a < b and c < d and p[a] == q[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        tail = []
        while a < b and c < d and p[b - 1] == q[d - 1]:
            b, d = b - 1, d - 1
            tail.append((b, d))
        found += tail
        if a == b or c == d:
            continue
        if b - a == d - c == 1:
            found.append((a, c))
            continue
        if b - a == 1 or (b - a) * (d - c) <= CELLS:
            weights = shapes.weights(p[a:b], q[c:d])
            best = _rows(weights)
            i, j = weights.shape
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((a + i, c + j))
            continue
        half = (a + b) // 2
        step = max(1, CELLS // (d - c))
        forth = back = np.zeros(d - c + 1, np.int32)
        for lo in range(a, half, step):
            forth = _carry(forth, shapes.weights(p[lo : min(half, lo + step)], q[c:d]))
        for hi in range(b, half, -step):
            back = _carry(back, shapes.weights(p[max(half, hi - step) : hi], q[c:d])[::-1, ::-1])
        cut = c + int((forth + back[::-1]).argmax())
        stack += [(a, half, c, cut), (half, b, cut, d)]
    return found


def _carry(best: np.ndarray, weights: np.ndarray) -> np.ndarray:
    best = best.copy()
    for row in weights:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row))
    return best


def align(shapes: Shapes, x: Node, y: Node) -> list[tuple[Node, Node]]:
    """Pairs of elements in the simple tree matching of two marked trees; below pairs of equal text nothing needs a score."""
    found, stack = [], [(x, y)]
    while stack:
        a, b = stack.pop()
        found.append((a, b))
        p, q = a.inner, b.inner
        if not p or not q:
            continue
        if a.shape == b.shape:
            stack += zip(p, q, strict=True)
            continue
        for i, j in sequence_pairs(shapes, shapes.parts[a.shape][1:], shapes.parts[b.shape][1:]):
            if p[i].name == q[j].name:
                stack.append((p[i], q[j]))
    return found
