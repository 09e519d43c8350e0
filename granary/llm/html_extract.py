"""HTML main-text extraction by wrapper induction.

Pages of a host are parsed to DOM trees and aligned by simple tree matching to one wrapper.  Each node of the wrapper sums up what the pages hold
there: how often the same text, how much of it in links, how much that varies freely.  From this the wrapper decides, for all its pages alike:
nodes with the same text in nearly all pages are template, blocks that are links in nearly all pages are navigation, and the
node in which most of the free text of the host gathers is the content slot.  A page's text is that of its nodes aligned to this slot, without
what is template.  So a page with a one-line article and a long advert is read as the other pages of its host are.  Roles of elements (tag, class,
id) name what no alignment can tell from an article, such as reader comments and forms; alone they decide only for hosts of too few pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Generator, Iterator, Sequence
from itertools import zip_longest
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Different pages in a group on average; how many must agree before a node is template or navigation, and in what share of them.
GROUP, LEAST_PAGES, LEAST_SHARE = 128, 8, 0.9
#: Share of a block's text in links from which on it is navigation; share of the free text that the next node inwards must hold.
LINKED, GATHERS = 0.8, 0.6
#: Above so many pairs of runs to match, the table of scores is filled by rows of NumPy, to the same result.
PAIRS = 4096
#: Similarities of shapes held at a time, 16 times as many in arrays (others are computed again), and the score of a cell that no match passes.
KNOWN, NEVER = 1 << 20, -(1 << 60)
#: Shapes with at most so many runs of children are compared with many others at once.
SHORT = 64
#: Texts of nodes are compared by length and value modulo this prime, so that those of nested nodes need not be held.
PRIME = (1 << 128) - 159

# Element names of HTML and what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
NOISE = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object embed svg canvas audio video dialog menu label fieldset datalist map figure-share".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend option".split()
)
#: Start tags before which an open paragraph ends.
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption legend option html body summary".split())
#: A start tag closes an open element of these names, up to the nearest of the bounds.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Words in class, id or role that mark what is not the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer footnav masthead topbar toolbar share sharing social related recommended trending widget comment comments disqus respond replies reply pagination pager skip paywall navigation complementary contentinfo search".split()
)
CONTENT_WORDS = frozenset("article post entry story main content maincontent".split())
#: Words that say where or in what form an element stands, not what it holds.
LAYOUT_WORDS = frozenset("box block bar wrap wrapper container list section area button buttons link links item items inner outer top bottom left right header head body slot unit panel col row group form field icon icons count text title page site global primary secondary mobile desktop fixed sticky the".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s/=]|$)|\baria-hidden\s*=\s*["']?true|\bstyle\s*=\s*(?:"[^"]*|'[^']*|)\b(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.IGNORECASE)


def noise_names(names: str) -> frozenset[str]:
    """The noise words among class, id and role names.  A name counts only if its other words are of layout or of an article's parts: ``share-price`` is no share button."""
    out: set[str] = set()
    for name in names.lower().split():
        words = set(_WORD.findall(name))
        if words and words <= NOISE_WORDS | LAYOUT_WORDS | CONTENT_WORDS:
            out |= words & NOISE_WORDS
    return frozenset(out)


class Node:
    __slots__ = ("tag", "label", "marks", "noise", "items", "text", "free", "linked")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag = tag
        self.marks: frozenset[str] = frozenset()
        self.noise: frozenset[str] = frozenset()
        self.label = tag
        if attrs:
            if "=" in attrs:
                found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
                names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
                if names.strip():
                    self.marks = frozenset(_WORD.findall(names.lower()))
                    self.noise = noise_names(names)
                self.label = f"{tag}.{found.get('class', '')}"
            if _HIDDEN.search(attrs):
                self.noise |= {"popup"}
        self.items: list[Node | str] = []  # children and text in order
        self.text: tuple[int, int] | None = None
        self.free = self.linked = 0

    def children(self) -> list[Node]:
        return [x for x in self.items if not isinstance(x, str)]


def parse(source: str) -> Node:
    """A tolerant DOM: implied end tags, raw text elements, stray end tags ignored, unclosed ones closed by their parents."""
    root = Node("#root")
    stack = [root]
    opened: Counter[str] = Counter()
    at, n = 0, len(source)

    def close(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].items.append(source[at:lt])
        if lt == n:
            break
        m = _TOKEN.match(source, lt)
        if not m:
            stack[-1].items.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("table", "article", "main") and tag in ("p", "b", "i", "a", "span", "em", "strong"):
                    break
            continue
        if tag in ENDS_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            own, bounds = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in own) else ():
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in own:
                    close(i)
                    break
        node = Node(tag, m[3])
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
            node.items.append(source[at : end.start() if end else n])
            at = source.find(">", end.start()) + 1 if end and source.find(">", end.start()) >= 0 else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def is_noise(node: Node, in_article: bool) -> bool:
    if node.tag in NOISE:
        return True
    if node.tag == "header" and not in_article:
        return True
    if node.tag in ("html", "body", "#root", "article", "main"):
        return False
    return bool(node.noise)


def _below(node: Node) -> list[Node]:
    """The node and all below it that hold text, parents first."""
    out = [node]
    for x in out:
        out += [c for c in x.items if not isinstance(c, str) and c.tag not in RAW]
    return out


def own_text(node: Node) -> tuple[int, int]:
    """Length and value of all text below, white space folded; what template nodes are compared by.

    A text's value is that of its bytes as one number, modulo a prime, so that of a node follows from those of its children at any depth.
    """
    if node.text is None:
        # (white space before, after, length, bytes, value); a text of white space alone has no length.
        parts: dict[int, tuple[bool, bool, int, int, int]] = {}
        for x in reversed(_below(node)):
            before, after, length, size, value = False, False, 0, 0, 0
            for c in x.items:
                if isinstance(c, str):
                    folded = " ".join(c.split())
                    raw = folded.encode("utf-8", "surrogatepass")
                    part = (c[:1].isspace(), c[-1:].isspace(), len(folded), len(raw), int.from_bytes(raw) % PRIME)
                elif c.tag in RAW:
                    continue
                else:
                    part = parts.pop(id(c))
                if not part[2]:
                    space = part[0] or part[1]
                    before, after = before or space and not length, after or space
                elif not length:
                    before, after, length, size, value = before or part[0], *part[1:]
                else:
                    if after or part[0]:
                        length, size, value = length + 1, size + 1, (value * 256 + 32) % PRIME
                    after, length, size, value = part[1], length + part[2], size + part[3], (value * pow(256, part[3], PRIME) + part[4]) % PRIME
            parts[id(x)] = before, after, length, size, value
            x.text = length, value
            x.linked = length if x.tag == "a" else sum(c.linked for c in x.items if not isinstance(c, str))
    return node.text


def measure(root: Node) -> None:
    """Give each node the length of its free text: neither in links nor in elements whose role is noise."""
    own_text(root)
    for x in reversed(_below(root)):
        if x.tag == "a" or x.tag in RAW or x is not root and is_noise(x, False):
            continue
        x.free = sum(len(c.strip()) if isinstance(c, str) else c.free for c in x.items)


def _runs(nodes: list[Node]) -> list[list[Node]]:
    """Neighbours of one label together: repeated siblings are one slot that iterates."""
    out: list[list[Node]] = []
    for x in nodes:
        if out and out[-1][0].label == x.label:
            out[-1].append(x)
        else:
            out.append([x])
    return out


class Wrapper:
    """A tree of labels that pages are aligned to; each node sums up what the pages hold there."""

    def __init__(self, label: str):
        self.label, self.pages, self.texts = label, 0, Counter()
        self.length = self.linked = self.free = 0
        self.children: list[Wrapper] = []

    @property
    def tag(self) -> str:
        return self.label.split(".")[0]

    def add(self, x: Node) -> None:
        self.pages += 1
        self.texts[own_text(x)] += 1
        self.length += own_text(x)[0]
        self.linked += x.linked
        self.free += x.free

    def is_template(self) -> bool:
        """Whole blocks only: a word that all pages set in bold is part of its sentence."""
        return self.pages >= LEAST_PAGES and self.tag in BLOCK - {"html", "body"} and self.texts.most_common(1)[0][1] >= LEAST_SHARE * self.pages

    def is_navigation(self, pages: int) -> bool:
        """A block that nearly every page has, and that holds hardly anything but links."""
        return self.pages >= max(LEAST_PAGES, LEAST_SHARE * pages) and self.tag in ("div", "ul", "ol", "menu", "section", "table", "dl") and self.length > 0 and self.linked >= LINKED * self.length


def _wrapper_runs(nodes: list[Wrapper]) -> list[list[Wrapper]]:
    out: list[list[Wrapper]] = []
    for x in nodes:
        if out and out[-1][0].label == x.label:
            out[-1].append(x)
        else:
            out.append([x])
    return out


#: A run of siblings: label, shape of the first, number.  The matching of two lists of runs: pairs of places, None for a run that stands alone.
Run = tuple[str, int, int]
Pairs = list[tuple[int | None, int | None]]


class Matcher:
    """Simple tree matching of a page against a wrapper, at any depth and width.

    Trees with the same labels in the same places have one shape (a number), and the similarity of two shapes is computed once.  Computations that
    need others first are generators on a stack of their own: they yield the pairs of shapes they wait for.
    """

    def __init__(self):
        self.shapes: dict[tuple[str, tuple[Run, ...]], int] = {}
        self.kids: list[tuple[Run, ...]] = []
        self.size: list[int] = []
        self.of: dict[int, int] = {}
        self.known: dict[tuple[int, int], int] = {}

    def shape(self, x: Wrapper | Node) -> int:
        todo = [x]
        while todo:
            y = todo[-1]
            if id(y) in self.of:
                todo.pop()
                continue
            runs = _wrapper_runs(y.children) if isinstance(y, Wrapper) else _runs(_kids(y))
            missing = [r[0] for r in runs if id(r[0]) not in self.of]
            if missing:
                todo += missing
                continue
            kids = tuple((r[0].label, self.of[id(r[0])], len(r)) for r in runs)
            s = self.shapes.setdefault((y.label, kids), len(self.kids))
            if s == len(self.kids):
                self.kids.append(kids)
                self.size.append(1 + sum(self.size[k] * n for _, k, n in kids))
            self.of[id(y)] = s
            todo.pop()
        return self.of[id(x)]

    def similarity(self, w: Wrapper, x: Node) -> int:
        """Nodes of equal label count one, plus the best order-preserving match of their children."""
        return self._run(self._similarity(self.shape(w), self.shape(x)))

    def _run(self, first: Generator):
        stack, pairs, value = [first], [], None
        while True:
            try:
                pair = stack[-1].send(value)
            except StopIteration as e:
                stack.pop()
                if not stack:
                    return e.value
                value = e.value
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[pairs.pop()] = value
                continue
            value = self.known.get(pair)
            if value is None:
                stack.append(self._similarity(*pair))
                pairs.append(pair)

    def _similarity(self, s: int, t: int) -> Generator:
        if s == t:
            return self.size[s]
        if not self.kids[s] or not self.kids[t]:
            return 1
        return 1 + (yield from self._match(self.kids[s], self.kids[t], False))[0]

    @staticmethod
    def forced(left: list[str], right: list[str]) -> bool:
        """Where labels are the same and each stands once, they leave no choice."""
        return left == right and len(set(left)) == len(left)

    def matched(self, left: list[list[Wrapper]], right: list[list[Node]]) -> list[tuple[list[Wrapper], list[Node]]]:
        """The best match of two lists of runs in order; a run without partner stands alone."""
        names = [a[0].label for a in left], [b[0].label for b in right]
        if not left or not right or self.forced(*names):
            return list(zip_longest(left, right, fillvalue=[]))
        both = set(names[0]) & set(names[1])
        runs = [[(r[0].label, self.shape(r[0]) if r[0].label in both else -1, len(r)) for r in side] for side in (left, right)]
        pairs = self._run(self._match(*runs, True))[1]
        return [([] if i is None else left[i], [] if j is None else right[j]) for i, j in pairs]

    def _match(self, left: Sequence[Run], right: Sequence[Run], path: bool) -> Generator:
        """Score of the best match and, if asked for, its pairs.  Long lists are matched to the same result by rows of NumPy."""
        n, m = len(left), len(right)
        known, size = self.known, self.size
        if self.forced([a[0] for a in left], [b[0] for b in right]):
            total = 0
            for (_, s, p), (_, t, q) in zip(left, right):
                total += (size[s] if s == t else known.get((s, t)) or (yield s, t)) * min(p, q)
            return total, None
        if n * m > PAIRS:
            return (yield from self._match_long(left, right, path))
        score = [[0] * (m + 1)]
        for label, s, p in left:
            above, row, best = score[-1], [0], 0
            for j, (other, t, q) in enumerate(right, 1):
                if above[j] > best:
                    best = above[j]
                if label == other:
                    best = max(best, above[j - 1] + (size[s] if s == t else known.get((s, t)) or (yield s, t)) * min(p, q))
                row.append(best)
            score.append(row)
        return score[n][m], self._back(n, 0, m, lambda i, j: score[i][j])[0][::-1] if path else None

    @staticmethod
    def _back(i: int, top: int, j: int, score: Callable[[int, int], int]) -> tuple[Pairs, int]:
        """The pairs of a best match, from row i up to row top, last one first, and the place reached in the other list.  Runs stand alone where that costs nothing."""
        out: Pairs = []
        while i > top or not top and j:
            if i and j and score(i, j) > max(score(i - 1, j), score(i, j - 1)):
                i, j = i - 1, j - 1
                out.append((i, j))
            elif i and (not j or score(i - 1, j) >= score(i, j - 1)):
                i -= 1
                out.append((i, None))
            else:
                j -= 1
                out.append((None, j))
        return out, j

    def _with_many(self, s: int, places: np.ndarray, counts: np.ndarray, inner: dict[tuple[str, int], int]) -> Generator:
        """Similarities of a shape to many at once, all with few children."""
        used = set(np.unique(places).tolist())
        score = np.zeros((len(places), places.shape[1] + 1), np.int64)
        for label, k, p in self.kids[s]:
            worth = np.zeros(len(inner) + 1, np.int64)
            for (other, t), c in inner.items():
                if other == label and c in used:
                    worth[c] = self.size[k] if k == t else self.known.get((k, t)) or (yield k, t)
            score[:, 1:] = np.maximum.accumulate(np.maximum(score[:, 1:], score[:, :-1] + worth[places] * np.minimum(counts, p)), axis=1)
        return 1 + score[:, -1]

    def _match_long(self, left: Sequence[Run], right: Sequence[Run], path: bool) -> Generator:
        """The same by the rows of the table, each only as far as a best match can pass.

        No match is better than the sums of what each run could add at most.  A cell that these sums keep below ``aim`` is on no match that reaches it, so if the
        best match within the other cells reaches it, that is the best of all, ties included.  Else the aim is lowered, to zero if need be: then all cells count.
        """
        n, m = len(left), len(right)
        most: list[dict[str, int]] = [{}, {}]
        for side, runs in zip(most, (left, right)):
            for label, s, k in runs:
                if s >= 0:
                    side[label] = max(side.get(label, 0), self.size[s] * k)
        before = []
        for runs, other in ((left, most[1]), (right, most[0])):
            before.append(np.cumsum([0, *(min(self.size[s] * k, other.get(label, 0)) if s >= 0 else 0 for label, s, k in runs)]))
        pl, pr = before
        total = int(min(pl[-1], pr[-1]))
        if n == m and all(a[0] == b[0] for a, b in zip(left, right)):
            straight = 0
            for (_, s, p), (_, t, q) in zip(left, right):
                straight += (self.size[s] if s == t else self.known.get((s, t)) or (yield s, t)) * min(p, q)
            if straight == total:
                return total, [(i, i) for i in range(n)] if path else None
        codes: dict[tuple[str, int], int] = {}
        code = np.array([codes.setdefault(b[:2], len(codes)) for b in right])
        shapes = [t for _, t in codes]
        many = np.array([b[2] for b in right], np.int64)
        # Similarities of a shape on the left to all on the right: 0 for other labels, -1 for those not asked for yet.
        rows: dict[int, np.ndarray] = {}
        by_label: dict[str, list[int]] = {}
        for (label, _), c in codes.items():
            by_label.setdefault(label, []).append(c)

        # The children of shapes with few of them, as numbers into their distinct runs' shapes; 0 is none.
        is_short = np.array([t >= 0 and len(self.kids[t]) <= SHORT for t in shapes])
        width = max((len(self.kids[t]) for t, few in zip(shapes, is_short) if few), default=0)
        places, counts = np.zeros((len(shapes), width), np.int32), np.zeros((len(shapes), width), np.int64)
        inner: dict[tuple[str, int], int] = {}
        for c in np.flatnonzero(is_short).tolist():
            for x, kid in enumerate(self.kids[shapes[c]]):
                places[c, x], counts[c, x] = inner.setdefault(kid[:2], len(inner) + 1), kid[2]

        def next_row(i: int, above: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Generator:
            label, s, k = left[i - 1]
            a, b, a0, b0 = int(lo[i]), int(hi[i]), int(lo[i - 1]), int(hi[i - 1])
            row = np.full(b - a + 1, NEVER, np.int64)
            x, y = max(a, a0), min(b, b0)
            if x <= y:
                row[x - a : y + 1 - a] = above[x - a0 : y + 1 - a0]
            x, y = max(a, a0 + 1), min(b, b0 + 1)
            if s >= 0 and x <= y:
                sims = rows.get(s)
                if sims is None:
                    if len(rows) * len(shapes) >= 16 * KNOWN:
                        rows.clear()
                    sims = rows[s] = np.zeros(len(shapes), np.int32)
                    sims[by_label.get(label, [])] = -1
                own = code[x - 1 : y]
                found = sims[own]
                if found.min() < 0:
                    missing = np.unique(own[found < 0])
                    short = missing[is_short[missing]]
                    if len(short) and len(self.kids[s]) <= SHORT:
                        sims[short] = yield from self._with_many(s, places[short], counts[short], inner)
                    for c in missing[sims[missing] < 0].tolist():
                        t = shapes[c]
                        sims[c] = self.size[s] if s == t else self.known.get((s, t)) or (yield s, t)
                    found = sims[own]
                part = row[x - a : y + 1 - a]
                np.maximum(part, above[x - 1 - a0 : y - a0] + found * np.minimum(many[x - 1 : y], k), out=part)
            return np.maximum.accumulate(row)

        step, gap = isqrt(n), 0
        while True:
            aim = max(total - gap, 0)
            lo = np.searchsorted(pr, aim - (pl[-1] - pl), "left")
            hi = np.searchsorted(pr, pr[-1] - aim + pl, "right") - 1
            if (lo <= hi).all():
                now, kept = np.zeros(int(hi[0]) + 1, np.int64), {}
                for i in range(n + 1):
                    if i:
                        now = yield from next_row(i, now, lo, hi)
                    if path and i % step == 0:
                        kept[i] = now
                if now[-1] >= aim:
                    break
            gap = max(4 * gap, total // 256 + 1)
        best = int(now[-1])
        if not path:
            return best, None
        # Back from the end, a block of rows after the other, each computed again from the row kept above it.
        out: Pairs = []
        i, j = n, m
        while i or j:
            top = max(i - 1, 0) // step * step
            block = [kept[top]]
            for k in range(top + 1, i + 1):
                block.append((yield from next_row(k, block[-1], lo, hi)))
            part, j = self._back(i, top, j, lambda k, x: int(block[k - top][x - lo[k]]) if lo[k] <= x <= hi[k] else NEVER)  # noqa: B023
            out += part
            i = top
        return best, out[::-1]


def _kids(x: Node) -> list[Node]:
    return [c for c in x.items if not isinstance(c, str) and c.tag not in RAW and c.tag not in VOID]


def align(w: Wrapper, x: Node, at: dict[int, Wrapper]) -> None:
    """Align the tree of a page to the wrapper; matched nodes count, unmatched ones are added to the wrapper."""
    todo, matcher = [(w, x)], Matcher()
    while todo:
        w, x = todo.pop()
        at[id(x)] = w
        w.add(x)
        kids = _kids(x)
        if not kids:
            continue
        merged: list[Wrapper] = []
        for a, b in matcher.matched(_wrapper_runs(w.children), _runs(kids)):
            slots = a + [Wrapper(b[0].label) for _ in range(len(b) - len(a))]
            todo += zip(slots, b)
            merged += slots
        w.children = merged


def content_slot(wrapper: Wrapper) -> Wrapper:
    """Descend from the root of the wrapper as long as one node inwards holds most of the host's free text, or is the explicit article and holds much of it."""
    node = wrapper
    while True:
        inner = [c for c in node.children if c.tag in BLOCK and c.tag not in ("p", "ul", "ol", "table", "pre", "blockquote")]
        best = max(inner, key=lambda c: c.free, default=None)
        explicit = [c for c in inner if c.tag in ("article", "main") and c.free >= GATHERS / 2 * node.free]
        if best is None or not best.free or best.free < GATHERS * node.free and len(explicit) != 1:
            return node
        node = best if best.free >= GATHERS * node.free else explicit[0]


def blocks(root: Node, template: set[int]) -> list[str]:
    """Text blocks below ``root`` in page order, without noise and template nodes."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        if now:
            text = " ".join(html.unescape("".join(now)).split())
            now.clear()
            if text:
                out.append(text)

    inside = root.tag in ("article", "main")
    todo: list[tuple[Node | str | None, bool]] = [(root, inside)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(x)
        elif x is not root and (is_noise(x, inside) or id(x) in template):
            continue
        elif x.tag == "br" or x.tag in VOID or x.tag in RAW:
            now.append(" ")
        else:
            own = x.tag in BLOCK or x is root
            if own:
                close()
                todo.append((None, inside))
            inside = inside or x.tag in ("article", "main")
            todo.extend((c, inside) for c in reversed(x.items))
    close()
    return out


def _articles(root: Node) -> list[Node]:
    """Outermost explicit articles, or mains; none if the page marks none."""
    for tags, marks in ((("article",), None), (("main",), {"main"}), ((), CONTENT_WORDS)):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            hit = x.tag in tags or marks is not None and x.tag in ("div", "section", "td") and bool(x.marks & marks)
            if x is not root and is_noise(x, False):
                continue
            if hit:
                found.append(x)
                continue
            todo.extend(reversed(x.children()))
        if found:
            return found
    return []


def extract_group(sources: list[str | None], induce: bool = True) -> list[str]:
    """Main texts of pages of one host: induce the wrapper from all of them, then read each page by it.  Without ``induce`` roles alone decide."""
    trees = [parse(s) if s else None for s in sources]
    wrapper, places = Wrapper("#root"), []
    firsts: dict[tuple[int, int], int] = {}
    for i, t in enumerate(trees):
        at: dict[int, Wrapper] = {}
        # Copies of a page say nothing about what is template: only the first is counted.
        if t is not None and firsts.setdefault(own_text(t), i) == i and induce:
            measure(t)
            align(wrapper, t, at)
        places.append(at)
    slot = content_slot(wrapper) if wrapper.pages >= LEAST_PAGES else None
    out: list[str] = []
    for i, t in enumerate(trees):
        if t is None:
            out.append("")
            continue
        first = firsts[own_text(t)]
        if first != i and sources[first] == sources[i]:
            out.append(out[first])
            continue
        at = places[i]
        if not at and first != i:
            mirror(trees[first], t, places[first], at)
        fixed = {k for k, w in at.items() if w.is_template() or w.is_navigation(wrapper.pages)}
        roots = _aligned(t, at, slot) or _articles(t) or [_region(t, fixed)]
        out.append("\n\n".join(x for r in roots for x in blocks(r, fixed)))
    return out


def _aligned(root: Node, at: dict[int, Wrapper], slot: Wrapper | None) -> list[Node]:
    """The page's nodes that stand in the wrapper's content slot and hold text."""
    return [] if slot is None else [x for x in _below(root) if at.get(id(x)) is slot and own_text(x)[0]]


def mirror(a: Node, b: Node, at: dict[int, Wrapper], out: dict[int, Wrapper]) -> None:
    """Carry the alignment of a page over to another whose tree has the same shape."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if id(a) in at and a.label == b.label:
            out[id(b)] = at[id(a)]
            todo += zip(a.children(), b.children())


def _region(root: Node, fixed: set[int]) -> Node:
    """Without an explicit article: descend from the root as long as one child holds most of the varying text."""

    sizes: dict[int, int] = {}
    for x in reversed(_below(root)):
        lost = sum(own_text(c)[0] - sizes[id(c)] for c in x.children() if c.tag not in RAW)
        sizes[id(x)] = 0 if is_noise(x, False) or id(x) in fixed else own_text(x)[0] - lost

    def size(x: Node) -> int:
        return sizes.get(id(x), 0)

    node = root
    while True:
        kids = [(size(c), c) for c in node.children() if c.tag in BLOCK and c.tag not in ("p", "ul", "ol", "table", "pre", "blockquote")]
        best = max(kids, key=lambda k: k[0], default=(0, None))
        if best[1] is None or best[0] < 0.6 * size(node) or best[0] == 0:
            return node
        node = best[1]


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every page.

    The different pages of a host are dealt to groups of about GROUP by a hash of their html, so a host with a third of all pages is many groups; each
    page takes part in the induction of its group's wrapper, and copies of it change neither groups nor wrappers.  Null html gives an empty text; pages of null
    or malformed urls form groups of their own; hosts with fewer than LEAST_PAGES different pages have no template and are read by the roles of elements.
    Repeated rows are repeated; an empty table gives an empty result; extra columns don't matter.
    """
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), host_of(url_col).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    groups = materialize(base.groupBy("host").agg(F.ceil(F.greatest(F.count_distinct(F.xxhash64("html")), F.lit(1)) / F.lit(GROUP)).cast("long").alias("groups")), "hosts")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copies within a batch move as one page with the ids of all.
        for b in batches:
            first: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                first.setdefault(key, []).append(i)
            order = pa.array([i for rows in first.values() for i in rows], pa.int64())
            ends = np.cumsum([0, *map(len, first.values())])
            ids = pa.StructArray.from_arrays([b.column(0).take(order), b.column(1).take(order)], ["page_id", "url"])
            own = pa.array([rows[0] for rows in first.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), b.column(2).take(own), b.column(3).take(own)], ["ids", "host", "html"])

    ids = "ids array<struct<page_id:bigint,url:string>>"
    once = base.select("page_id", "url", "host", "html").mapInArrow(collapse, f"{ids}, host string, html string")
    dealt = once.join(groups, "host").withColumn("g", F.pmod(F.xxhash64("html"), F.col("groups"))).select("host", "g", "ids", "html")

    def run(part: pa.Table) -> pa.Table:
        html_of = part.column("html").to_pylist()
        pages = sorted({x for x in html_of if x is not None})
        text = dict(zip(pages, extract_group(pages)))
        return pa.table({"ids": part.column("ids"), "text": pa.array([text.get(x, "") for x in html_of], pa.string())})

    done = dealt.groupBy("host", "g").applyInArrow(run, f"{ids}, text string")
    return done.select(F.explode("ids").alias("id"), "text").select("id.page_id", "id.url", "text")
