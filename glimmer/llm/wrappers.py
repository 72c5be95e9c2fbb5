"""HTML extraction: union-free regular expressions, inferred per host by aligning the token streams of its pages.

A page is a stream of tokens: tags open and close, texts stand between them. Streams of a host are aligned one after
another, level by level. Where texts differ, the wrapper gets a slot; where tags differ, what only some pages have
becomes an optional group; tags that follow each other again and again become a repeated group. The wrapper then tells
the article from the template: the article is where the slots hold most text, and a text in it that nearly all pages of
the host have in the same place belongs to the template. Such texts are counted exactly, over all pages of a host.
"""

from __future__ import annotations

import html
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import pieces_of, sized, stored, whole
from glimmer.llm.url_rules import host_of

# Names that HTML gives to elements, and names that sites give to what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msqrt".split())
CLOSES_P = set("address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SCOPES = set("table td th caption template object".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NOT_ARTICLE = set("nav footer aside head button select dialog menu option noscript svg canvas".split())
FRAMES = set("form object template".split())
NOT_ARTICLE_NAMES = set("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header login masthead modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related sharing share sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget menu".split())
NEUTRAL_NAMES = set("site page global main top bottom left right inner outer wrapper wrap container box bar block list area section post posts item items button buttons link links form primary secondary text entry content thread row col column holder panel unit slot".split())
# End of fixed values.
#: A text is the template's if this share of the pages that have its place, and at least so many, have it there.
SHARED, MIN_PAGES = 0.9, 3
#: Template texts are left out only if there are different texts of the pages' own for this share of the host's pages: else
#: its pages are copies of few.
OWN = 0.5
#: So many of the smallest hashes of a place's texts are kept, to see whether pages differ there.
VALUES = 4
#: Pages that are aligned one after another, and wrappers that are; their results are aligned in their turn.
PAGES_AT_ONCE, WRAPPERS_AT_ONCE = 256, 64
#: A part that under this share of the host's pages have is left out of the wrapper, and no text in a place that fewer have
#: is the template's: wrapper and template of a host stay bounded. The texts of such pages are kept.
RARE = 0.01
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>"
    r"|<[!?/][^>]*>",
    re.S,
)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _not_article(name: str) -> bool:
    """The name says that an element is not the article: one of its parts does, and no other part says anything else."""
    parts = [p for p in re.split(r"[-_\d]+", name) if p]
    return any(p in NOT_ARTICLE_NAMES for p in parts) and all(p in NOT_ARTICLE_NAMES or p in NEUTRAL_NAMES for p in parts)


class Node:
    """An element: key (tag and class names, without numbers), children (nodes, and texts with whether they are links)."""

    __slots__ = ("article", "children", "frame", "heading", "key", "named", "outside", "prose", "size", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower().split()) for m in _NAME.finditer(attributes)] if "=" in attributes else []
        self.tag = "main" if any(k == "role" and "main" in v for k, v in found) else tag
        self.children, self.size, self.article, self.heading, self.prose = [], 0, False, False, False
        classes = sorted({re.sub(r"\d+", "0", w) for k, v in found if k == "class" for w in v})
        self.key = self.tag if not classes or self.tag in ("html", "body", "article", "main", "p") or self.tag in HEADINGS else f"{self.tag}.{'.'.join(classes)}"
        self.named = self.tag not in ("html", "body", "main", *HEADINGS) and any(_not_article(w) for _, v in found for w in v)
        self.outside, self.frame = self.tag in NOT_ARTICLE, self.tag in FRAMES


def parse(text: str) -> Node:
    """The tree of a page; wrongly nested and unclosed elements end where their parents do, at any depth."""
    root = Node("")
    stack, opened, at, link = [root], Counter(), 0, 0

    def leave(tag: str, walls: set[str]) -> None:
        nonlocal link
        if opened[tag]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    opened.subtract(n.tag for n in stack[i:])
                    del stack[i:]
                    if len(stack) < link:
                        link = 0
                    return
                if stack[i].tag in walls:
                    return

    while m := _TOKEN.search(text, at):
        if m.start() > at:
            stack[-1].children.append((text[at : m.start()], link > 0))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "a":
            link = 0 if m[1] else len(stack)
        if m[1]:
            if tag == "br":
                stack[-1].children.append((" ", False))
            elif tag not in VOID and tag not in INLINE:
                leave(tag, SCOPES if tag not in SCOPES else set())
            continue
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag == "br":
            stack[-1].children.append((" ", False))
        if tag in INLINE or (tag in VOID and tag != "hr"):
            continue
        if tag in CLOSES_P:
            leave("p", {"article", "div", "section", "td", "th", "li", "blockquote", "main", "body", "table", "aside"})
        if tag in ("li", "option"):
            leave(tag, {"ul", "ol", "menu", "select"})
        elif tag in ("dt", "dd"):
            leave("dt", {"dl"})
            leave("dd", {"dl"})
        elif tag in ("td", "th", "tr"):
            for t in ("td", "th") if tag != "tr" else ("td", "th", "tr"):
                leave(t, {"table"})
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag != "hr" and not (m[3].rstrip().endswith("/") and (tag in ("svg", "math", "object", "path") or "-" in tag)):
            stack.append(node)
            opened[node.tag] += 1
    if at < len(text):
        stack[-1].children.append((text[at:], link > 0))
    _judge(root)
    return root


def _weighed(root: Node) -> list[Node]:
    """The elements that may be in the article, with the text that each holds and what speaks for it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.outside]
    for node in reversed(order):
        node.size, node.article, node.heading, node.prose = 0, False, False, False
        for c in node.children:
            if not isinstance(c, Node):
                node.size += len(c[0]) - c[0].count(" ")
            elif not c.outside:
                node.size += c.size
                node.article |= c.article or (c.tag in ("article", "main") and not c.named)
                node.heading |= not c.frame and (c.heading or (c.tag == "h1" and not c.named))
                node.prose |= c.prose or c.tag == "p" or c.tag in HEADINGS
    return order


def _judge(root: Node) -> None:
    """Frames (forms and the like) and names put an element outside of the article unless it holds the article.

    A frame holds it with an article or main element, or with headings or paragraphs and most of the text; a named
    element with an article or main element, a first heading or most of the text.
    """
    order = _weighed(root)
    frames = [n for n in order if n.frame]
    for node in frames:
        node.outside = not node.article and (not node.prose or node.size < 0.8 * root.size)
    if any(n.outside for n in frames):
        order = _weighed(root)
    for node in order:
        if node.named and not node.article and not node.heading and node.size < 0.8 * root.size:
            node.outside = True


Token = tuple[int, str, int]


def tokens(root: Node) -> list[Token]:
    """(1, key, 0) and (-1, key, 0) where an element opens and closes, (0, text, characters in links) for the text of a block.

    What is outside of the article has no tokens, and of headers in an article the headings alone.
    """
    out: list[Token] = []
    run: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = "".join(run)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            out.append((0, text, min(links, len(text))))
        run.clear()
        links = 0

    # Node, next child, whether it is in an article, whether only headings count.
    stack: list[list] = [[root, 0, False, False]]
    while stack:
        node, i, inside, only = top = stack[-1]
        if i == len(node.children):
            flush()
            stack.pop()
            if stack:
                out.append((-1, node.key, 0))
            continue
        top[1] += 1
        child = node.children[i]
        if not isinstance(child, Node):
            if not only:
                run.append(child[0])
                links += len(child[0]) if child[1] else 0
        elif not child.outside and (inside or child.tag != "header"):
            flush()
            out.append((1, child.key, 0))
            stack.append([child, 0, inside or child.tag in ("article", "main", "section"), (only or child.tag == "header") and child.tag not in HEADINGS])
    return out


class Part:
    """A part of a wrapper: an element, a text ("#") or a group of several parts ("(...)").

    slot: whether pages have different texts there; value: the smallest hashes of the texts of each page, by which they
    are told apart. pages: how many have the part; mass and links: their characters, and those in links.
    """

    __slots__ = ("children", "key", "links", "mass", "optional", "pages", "repeated", "slot", "value")

    def __init__(self, key, optional=False, repeated=False, slot=False, value=(), pages=1, mass=0, links=0, children=None):
        self.key, self.optional, self.repeated, self.slot, self.value = key, optional, repeated, slot, value
        self.pages, self.mass, self.links, self.children = pages, mass, links, [] if children is None else children


def outline(stream: list[Token]) -> Part:
    """A page's own wrapper: its token stream with tandem repeats folded into repeated groups."""
    root = Part("")
    stack, deepest = [root], 1
    for kind, what, links in stream:
        if kind > 0:
            part = Part(what)
            stack[-1].children.append(part)
            stack.append(part)
            deepest = max(deepest, len(stack))
            if deepest > 500:
                _allow(deepest)
        elif kind < 0:
            part = stack.pop()
            part.children = _folded(part.children)
        else:
            stack[-1].children.append(Part("#", value=(_hash(what),), mass=len(what), links=links))
    root.children = _folded(root.children)
    return root


def _allow(depth: int) -> None:
    """Parts are walked by functions that call themselves once a level; such calls take no room on the machine's stack."""
    if sys.getrecursionlimit() < 8 * depth + 5000:
        sys.setrecursionlimit(16 * depth + 10_000)


def _common(text: str, i: int, j: int, most: int) -> int:
    """How many characters from i on equal those from j on, at most `most`: doubled while they do, then halved."""
    most, step, done = min(most, len(text) - j), 1, 0
    while done < most and text[i + done : i + min(done + step, most)] == text[j + done : j + min(done + step, most)]:
        done = min(done + step, most)
        step *= 2
    low, high = done, min(done + step, most) - 1
    while low < high:
        middle = (low + high + 1) // 2
        if text[i + low : i + middle] == text[j + low : j + middle]:
            low = middle
        else:
            high = middle - 1
    return max(low, done)


def _repeats(text: str, turned: str, width: int) -> Iterator[tuple[int, int]]:
    """(start, number) of the stretches of a text that repeat `width` characters two times or more, from left to right.

    turned is the text from its end.

    Such a stretch holds two neighbouring multiples of the width with the same character, so only these are looked at: all
    widths together look at n log n places.
    """
    n, end = len(text), 0
    for at in [width * m for m, (x, y) in enumerate(zip(text[::width], text[width::width], strict=False)) if x == y]:
        if at + width <= end:
            continue
        stop = at + width + _common(text, at, at + width, n)
        start = max(end, at - _common(turned, n - at - width, n - at, width - 1))
        if stop - start >= 2 * width:
            yield start, (stop - start) // width
            end = start + (stop - start) // width * width


def _folded(parts: list[Part]) -> list[Part]:
    """Tandem repeats of any width become one repeated part, or a repeated group of several parts; the narrowest first."""
    width = 1
    while 2 * width <= len(parts):
        if width == 1:
            keys, numbers = [p.key for p in parts], {}
            text = "".join([chr(numbers.setdefault(k, len(numbers))) for k in keys])
            turned = text[::-1]
            if len(numbers) == len(keys):
                break
        out, at = [], 0
        for start, number in _repeats(text, turned, width):
            unit = parts[start : start + width]
            for k in range(start + width, start + number * width, width):
                unit = [_joined(a, b, True) for a, b in zip(unit, parts[k : k + width], strict=True)]
            if width == 1:
                unit[0].repeated = True
            else:
                unit = [Part(f"({','.join(keys[start : start + width])})", repeated=True, pages=max(p.pages for p in unit), children=unit)]
            out += parts[at:start] + unit
            at = start + number * width
        parts, width = (out + parts[at:], 1) if at else (parts, width + 1)
    return parts


def _joined(a: Part, b: Part, same_page: bool) -> Part:
    """What describes both parts. On one page texts add up; texts that differ between pages make a slot."""
    slot = a.slot or b.slot or (not same_page and a.value != b.value)
    value = a.value if a.value == b.value else tuple(sorted({*a.value, *b.value})[:VALUES])
    pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    return Part(a.key, a.optional or b.optional, a.repeated or b.repeated, slot, value, pages, a.mass + b.mass, a.links + b.links, _aligned(a.children, b.children, same_page))


def merge(a: Part, b: Part) -> Part:
    """The wrapper of all pages that a and b describe."""
    return _joined(a, b, False)


def _in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most of the pairs, given by their first places, whose second places rise."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        tails[k : k + 1], ends[k : k + 1] = [j], [n]
        before.append(ends[k - 1] if k else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a and b that stand for each other, rising in both.

    What begins and what ends both, then keys that come once in both; between these, what begins and ends both parts, and
    of the rest the k-th of a key in a for the k-th in b. All of it takes n log n.
    """

    def ends(i: int, x: int, j: int, y: int) -> tuple[int, int]:
        low, high, most = 0, 0, min(x - i, y - j)
        while low < most and a[i + low] == b[j + low]:
            low += 1
        while high < most - low and a[x - 1 - high] == b[y - 1 - high]:
            high += 1
        return low, high

    def numbered(keys: list[str], start: int, stop: int) -> dict[tuple[str, int], int]:
        seen: Counter[str] = Counter()
        out = {}
        for i in range(start, stop):
            seen[keys[i]] += 1
            out[keys[i], seen[keys[i]]] = i
        return out

    low, high = ends(0, len(a), 0, len(b))
    x, y = len(a) - high, len(b) - high
    in_a, in_b = Counter(a[low:x]), Counter(b[low:y])
    place = {k: j for j, k in enumerate(b[low:y], low) if in_b[k] == 1}
    fixed = _in_order([(i, place[k]) for i, k in enumerate(a[low:x], low) if in_a[k] == 1 and k in place])
    out = [(i, i) for i in range(low)]
    i, j = low, low
    for p, q in [*fixed, (x, y)]:
        first, last = ends(i, p, j, q)
        out += [(i + k, j + k) for k in range(first)]
        others = numbered(b, j + first, q - last)
        out += _in_order([(n, others[k]) for k, n in numbered(a, i + first, p - last).items() if k in others])
        out += [(p - k, q - k) for k in range(last, 0, -1)]
        if p < x:
            out.append((p, q))
        i, j = p + 1, q + 1
    return out + [(x + k, y + k) for k in range(high)]


def _aligned(a: list[Part], b: list[Part], same_page: bool) -> list[Part]:
    """Two streams of one level: common parts are joined, and what lies between them becomes optional."""
    ka, kb = [p.key for p in a], [p.key for p in b]
    if ka == kb:
        return [_joined(x, y, same_page) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for x, y in [*_matched(ka, kb), (len(a), len(b))]:
        for part in (*a[i:x], *b[j:y]):
            part.optional = True
            out.append(part)
        if x < len(a):
            out.append(_joined(a[x], b[y], same_page))
        i, j = x + 1, y + 1
    return _folded(out)


def pruned(wrapper: Part) -> Part:
    """Without the parts that few of its pages have."""
    if wrapper.pages * RARE > 1:
        stack = [wrapper]
        while stack:
            part = stack.pop()
            part.children = [c for c in part.children if c.pages >= wrapper.pages * RARE]
            stack += part.children
    return wrapper


def dumped(wrapper: Part) -> str:
    """In the order of the stream, each part with its number of children."""
    rows, stack = [], [wrapper]
    while stack:
        p = stack.pop()
        rows.append([len(p.children), p.key, int(p.optional), int(p.repeated), int(p.slot), p.value, p.pages, p.mass, p.links])
        stack += reversed(p.children)
    return json.dumps(rows, separators=(",", ":"))


def loaded(text: str) -> Part:
    root, open_parts = None, []
    for n, key, optional, repeated, slot, value, pages, mass, links in json.loads(text):
        part = Part(key, bool(optional), bool(repeated), bool(slot), tuple(value), pages, mass, links)
        while open_parts and not open_parts[-1][1]:
            open_parts.pop()
        if open_parts:
            open_parts[-1][0].children.append(part)
            open_parts[-1][1] -= 1
        else:
            root = part
        open_parts.append([part, n])
        if len(open_parts) > 500:
            _allow(len(open_parts))
    return root


def expression(wrapper: Part) -> str:
    """The wrapper as a regular expression: # is a slot, = a fixed text, ? and + follow optional and repeated groups."""
    out: list[str] = []
    stack: list[Part | str] = [wrapper]
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            out.append(p)
            continue
        mark = ("+" if p.repeated else "") + ("?" if p.optional else "")
        group = p.key.startswith("(") or (mark and p.key)
        if p.key == "#":
            out.append(("#" if p.slot else "=") + mark)
        else:
            tag = "" if p.key.startswith("(") else p.key
            out.append(("(" if group else "") + (f"<{tag}>" if tag else ""))
            stack.append((f"</{tag}>" if tag else "") + (f"){mark}" if group else ""))
            stack += reversed(p.children)
    return "".join(out)


def below(path: int, key: str) -> int:
    """The path of an element in the element of a path; groups are no elements."""
    return path if key in ("", "#") or key.startswith("(") else _hash(f"{path}/{key}")


def article(wrapper: Part) -> int:
    """The path of the article.

    The article is an article or main element if one holds much of the slots' text, or else the element down to which
    the text does not part. Text in links counts nothing, fixed text little. Of elements that hold the same the first counts.
    """
    order: list[tuple[Part, int, int]] = []
    stack = [(wrapper, 0, 0)]
    while stack:
        part, path, depth = stack.pop()
        path = below(path, part.key)
        order.append((part, path, depth))
        stack += [(c, path, depth + 1) for c in part.children]

    def fixed(part: Part) -> bool:
        return not part.slot and part.pages >= MIN_PAGES

    text: dict[int, float] = {}
    for part, _, _ in reversed(order):
        own = (part.mass - part.links) * (0.2 if fixed(part) else 1.0) if part.key == "#" else 0.0
        text[id(part)] = own + sum([text[id(c)] for c in part.children])
    total = text[id(wrapper)]
    named = [(part, path, depth) for part, path, depth in order if part.key in ("article", "main")]
    most = max((text[id(x[0])] for x in named), default=0)
    if named and most >= 0.3 * total:
        part, path, _ = max((x for x in named if text[id(x[0])] >= 0.8 * most), key=lambda x: x[2])
    else:
        part, path = wrapper, 0
        while True:
            down = max(part.children, key=lambda c: text[id(c)], default=None)
            if down is None or down.repeated or down.key in ("#", "p", *HEADINGS) or text[id(down)] < 0.7 * text[id(part)]:
                break
            part, path = down, below(path, down.key)

    return path


def texts_of(stream: list[Token]) -> list[tuple[int | None, int | None, int | None]]:
    """What a page adds to the counts of its host, each once: (path, mark, kind) of texts, (path, None, None) of places,
    and (None, None, None) for the page.

    A mark is a text in its place. The kind of a text is its three longest words, so that a text with a word changed is
    mostly of the same kind; headings and texts in links have none.
    """
    paths, heading = [0], 0
    out: set[tuple[int | None, int | None, int | None]] = {(None, None, None)}
    for kind, what, links in stream:
        if kind > 0:
            paths.append(below(paths[-1], what))
            heading += what in HEADINGS
        elif kind < 0:
            paths.pop()
            heading -= what in HEADINGS
        else:
            words = sorted({(len(w), w) for w in what.split()})[-3:] if not heading and 2 * links < len(what) else []
            out |= {(paths[-1], None, None), (paths[-1], _mark(paths[-1], what), _hash(" ".join(w for _, w in words)) if words else None)}
    return list(out)


def _mark(path: int, text: str) -> int:
    return _hash(f"{path}#{text}")


def _blocks(stream: list[Token], path: int, template: set[int]) -> list[str]:
    """The texts below the elements of a path, in page order, without the template's.

    A heading of the template stays if text of the page follows under it.
    """
    found: list[tuple[str, int, bool]] = []
    paths, heading, inside = [0], 0, 1 if path == 0 else 0
    for kind, what, _ in stream:
        if kind > 0:
            paths.append(below(paths[-1], what))
            inside += paths[-1] == path
            heading = int(what[1]) if what in HEADINGS else heading
        elif kind < 0:
            inside -= paths.pop() == path
            heading = 0 if what in HEADINGS else heading
        elif inside:
            found.append((what, heading, _mark(paths[-1], what) in template))
    out: list[str] = []
    following = 7  # the level of the last heading that is already open below, or 0 if text of the page is
    for text, level, shared in reversed(found):
        if not shared:
            out.append(text)
            following = level or 0
        elif level and following < level:
            out.append(text)
            following = level
        elif level:
            following = max(following, level)
    return out[::-1]


def extract(text: str, path: int | None = None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The article of a page by its host's wrapper; by the page's own outline if the wrapper's article is not in it."""
    stream = tokens(parse(text))
    out = _blocks(stream, path, template) if path is not None else []
    if not out:
        out = _blocks(stream, article(outline(stream)), set()) or _blocks(stream, 0, set())
    return "\n".join(out)


_OUTLINES = "host string, place long, wrapper string, texts array<struct<path: long, mark: long, kind: long>>"


def _outlines(batches: Iterator[pa.RecordBatch]):
    triple = pa.list_(pa.struct([(n, pa.int64()) for n in ("path", "mark", "kind")]))
    for batch in pieces_of(batches, "html"):
        streams = [tokens(parse(t)) for t in batch.column(2).to_pylist()]
        texts = [[dict(zip(("path", "mark", "kind"), x, strict=True)) for x in texts_of(t)] for t in streams]
        wrappers = [dumped(outline(t)) for t in streams]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(wrappers, pa.string()), pa.array(texts, triple)], ["host", "place", "wrapper", "texts"])


def _merged(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by host, bucket and place in; one wrapper for each host and bucket out. Pages that are the same count once."""
    key = wrapper = last = None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([dumped(pruned(wrapper))], pa.string())], ["host", "place", "wrapper"])

    for batch in batches:
        for host, bucket, place, text in zip(*(batch.column(n).to_pylist() for n in ("host", "bucket", "place", "wrapper")), strict=True):
            if (host, bucket) != key:
                if key:
                    yield row()
                key, wrapper, last = (host, bucket), loaded(text), place
            elif place != last:
                wrapper, last = merge(wrapper, loaded(text)), place
    if key:
        yield row()


def _articles(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        found = [article(loaded(t)) for t in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("wrapper"), pa.array(found, pa.int64())], ["host", "wrapper", "path"])


def _templates(outlines: DataFrame) -> DataFrame:
    """(host, template): the marks of the template's texts, counted over the different pages of a host.

    A text is the template's if SHARED of the pages that have its place have it there, MIN_PAGES at least, and RARE of the
    host's pages have the place. A host with fewer kinds of other texts, not those of its template, than OWN of its pages has
    copies only, and no template.
    """
    rows = outlines.select("host", "place", F.explode("texts").alias("t")).select("host", "place", "t.*").distinct()
    counts = stored(rows.groupBy("host", "path", "mark", "kind").agg(F.count("*").alias("n")), "wrapper-texts")
    hosts = counts.where("path is null").select("host", F.col("n").alias("host_pages"))
    places = counts.where("path is not null and mark is null").select("host", "path", F.col("n").alias("place_pages"))
    often = counts.where(F.col("mark").isNotNull() & (F.col("n") >= MIN_PAGES)).select("host", "path", "mark", "kind", "n")
    places = places.where(F.col("place_pages") >= MIN_PAGES).join(hosts, "host").where(F.col("place_pages") >= RARE * F.col("host_pages"))
    shared = stored(often.join(places, ["host", "path"]).where(F.col("n") >= SHARED * F.col("place_pages")).select("host", "mark", "kind"), "wrapper-shared")
    own = counts.where("kind is not null").join(sized(shared.where("kind is not null").select("host", "kind")), ["host", "kind"], "left_anti").select("host", "kind").distinct()
    own = own.groupBy("host").agg(F.count("*").alias("kinds")).join(hosts, "host").where(F.col("kinds") >= OWN * F.col("host_pages"))
    return shared.join(own.select("host"), "host").groupBy("host").agg(F.sort_array(F.collect_list("mark")).alias("template"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, path, template): a host's wrapper over all its pages, the path of its article, the template's texts.

    A host's pages are dealt to buckets of about PAGES_AT_ONCE by their hash and aligned in its order, then the buckets'
    wrappers WRAPPERS_AT_ONCE at a time: no task holds a host's pages, and the result does not depend on how rows lie.
    """
    wide = "host string, place long, wrapper string"
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64(whole("html")).alias("place"), whole("html").alias("html"))
    outlines = stored(keyed.mapInArrow(_outlines, _OUTLINES), "wrapper-outlines")
    counts = stored(outlines.groupBy("host").agg(F.ceil(F.count("*") / F.lit(PAGES_AT_ONCE)).alias("buckets")), "wrapper-hosts")
    buckets = counts.agg(F.max("buckets")).head()[0] or 1
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def aligned(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "host", "bucket").sortWithinPartitions("host", "bucket", "place").mapInArrow(_merged, wide)

    rows = outlines.drop("texts").join(sized(counts), "host").withColumn("bucket", F.pmod("place", "buckets")).drop("buckets")
    rows = aligned(rows)
    while buckets > 1:
        rows = aligned(rows.withColumn("bucket", F.floor(F.col("place") / WRAPPERS_AT_ONCE)))
        buckets = -(-buckets // WRAPPERS_AT_ONCE)
    return rows.mapInArrow(_articles, "host string, wrapper string, path long").join(_templates(outlines), "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages: the article's blocks, one a line.

    Null html counts as empty and gives an empty text; a null url or one without host belongs to the host "". A page
    without its host's article is read by its own outline. Of places that hold the same amount of text the first is the
    article. Pages of any length, depth and width are read whole. Repeated rows and ids stay, and count once for the
    template; an empty table is fine, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        known: dict[tuple[int, ...], frozenset[int]] = {}
        for batch in pieces_of(batches, "html"):
            texts = []
            for page, path, template in zip(*(batch.column(n).to_pylist() for n in ("html", "path", "template")), strict=True):
                marks = tuple(template or ())
                if marks not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[marks] = frozenset(marks)
                texts.append(extract(page, path, known[marks]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    found = sized(stored(infer_wrappers(pages).select("host", "path", "template"), "wrapper-paths"))
    keyed = pages.select("page_id", "url", whole("html").alias("html"), host_of(F.col("url")).alias("host"))
    return keyed.join(found, "host", "left").select("page_id", "url", "html", "path", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
