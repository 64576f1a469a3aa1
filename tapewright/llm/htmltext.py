"""Main-text extraction by nearest-URL page differencing.

Pages of a host that are next to each other by URL path share its template. Each
page becomes lines of text (blocks) in page order; a page's lines are aligned with
those of its neighbours by longest common subsequence, and shared lines go unless
the neighbour is a copy. Elements that never hold main text go by their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is never main text.
SKIP = {"script", "style", "noscript", "template", "svg", "math", "head", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "option", "iframe", "object", "canvas", "dialog", "menu", "video", "audio"}
#: Elements that hold the article where a page marks it.
ARTICLE = {"article", "main"}
#: Elements without an end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements within a line; all others end it.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Parts of class, id or role that name menus, notices, adverts, comments and the like.
ASIDE = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|newsletter|subscribe|signup|nav\w*|menu\w*|breadcrumb\w*|header|masthead|footer|sidebar\w*|aside|widget\w*|related|recommend\w*|share|sharing|social|comment\w*|disqus|respond|reply|replies|login|search|pagination|pager|complementary|contentinfo|navigation)(?:$|[\s_-])", re.I)
#: Words by which a name says that there is no such part, or one beside the text.
NOT_ASIDE = {"no", "not", "non", "without", "has", "have", "with"}
#: Parts that are skipped even where they hold most of a page's text.
ANSWERS = re.compile(r"(?:^|[\s_-])(?:related|recommend\w*|comment\w*|disqus|respond|reply|replies)(?:$|[\s_-])", re.I)
#: Elements that a start tag of the second set ends, unless one of the third is between.
IMPLIED = [
    ({"p"}, {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "dd", "dt", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}, {"table", "td", "th", "caption", "button", "object"}),
    ({"li"}, {"li"}, {"ul", "ol", "menu"}),
    ({"dd", "dt"}, {"dd", "dt"}, {"dl"}),
]
OPENING = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?([a-zA-Z][a-zA-Z0-9:-]*))")
#: A tag's attributes up to the > that no quotes hold.
ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
SPACE = re.compile(r"\s+")


def aside_names(attributes: str) -> list[str]:
    """Those names of an element's class, id and role that say its content isn't main text."""
    words = [w for x in NAMES.findall(attributes) for w in (x[1] or x[2] or x[3]).split()]
    return [w for w in words if ASIDE.search(w) and not NOT_ASIDE & set(re.split(r"[_-]+", w.lower()))]


def tags(page: str):
    """(start, end, name, attributes) of a page's tags in order; name is '' for comments,
    declarations and sections of raw data, whose ends are found by their own marks.

    Every character is read a fixed number of times: once a tag has quotes that
    never end, it and all later ones end at the first >, and once there is no > left,
    the rest is text.
    """
    at, strict, no_data_end = 0, True, False
    while m := OPENING.search(page, at):
        mark = page[m.start() + 1 : m.end()]
        if m[1]:
            x = ATTRIBUTES.match(page, m.end()) if strict else None
            strict = strict and x is not None
            end = x.end() if x else page.find(">", m.end()) + 1
            if not end:
                return
            yield m.start(), end, m[1].lower(), page[m.end() : end - 1]
        else:
            close, missing = {"!--": ("-->", len(page)), "![CDATA[": ("]]>", m.end())}.get(mark, (">", m.end()))
            found = -1 if close == "]]>" and no_data_end else page.find(close, m.end())
            no_data_end = no_data_end or (close == "]]>" and found < 0)
            end = found + len(close) if found >= 0 else missing
            if found >= 0 or missing == len(page):
                yield m.start(), end, "", ""
            elif close == ">":
                return
        at = end


class Stack:
    """Open elements, with the places of each name."""

    def __init__(self):
        self.items: list[tuple] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, *state) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        self.items.append((name, *state))

    def nearest(self, names) -> int:
        """Place of the innermost open element with one of the names, or -1."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def cut(self, where: int) -> list[tuple]:
        gone = self.items[where:]
        for name, *_ in reversed(gone):
            self.places[name].pop()
        del self.items[where:]
        return gone


def page_lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, within the marked article, within an element to skip) of a page's lines, in order.

    An element that would be skipped stays if it holds a main element, or all text
    of the page's articles, or (by its name only, on pages without an article
    elsewhere) most of the page's text; answers and related pages must hold a main.
    The time grows with the page's length, also where elements don't end.
    """
    out: list[tuple[str, bool, int]] = []  # text, inside, innermost element to skip
    stack = Stack()  # name, inside, skip
    found: list[tuple[int, bool, bool]] = []  # elements to skip: the one around it, by tag, answers
    mains: set[int] = set()
    parts: list[str] = []
    inside, skip = False, -1

    def end() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((text, inside, skip))

    def close(where: int) -> None:
        nonlocal inside, skip
        gone = stack.cut(where)
        if any(x[1:] != (inside, skip) for x in gone):
            end()
        inside, skip = gone[0][1:]

    at = raw = 0
    for start, stop, name, attributes in tags(page):
        if start < raw:
            continue
        parts.append(page[at:start])
        at = stop
        if not name:
            continue
        if name not in INLINE:
            end()
        if page[start + 1] == "/":
            if (where := stack.nearest((name,))) >= 0:
                close(where)
            continue
        for open_, by, scope in IMPLIED:
            if name in by:
                where = stack.nearest(open_ | scope)
                if where >= 0 and stack.items[where][0] in open_:
                    close(where)
        if name in VOID:
            continue
        if name in RAW:
            last = RAW[name].search(page, stop)
            at = raw = last.end() if last else len(page)
            continue
        names = aside_names(attributes) if name not in ("html", "body") and name not in ARTICLE else []
        aside = name in SKIP or bool(names)
        if aside or (name in ARTICLE and not inside):
            end()
        if not attributes.endswith("/"):
            stack.push(name, inside, skip)
            if aside:
                found.append((skip, name in SKIP and name != "form", any(ANSWERS.search(x) for x in names)))
                skip = len(found) - 1
            inside = inside or name in ARTICLE
            if name == "main":
                mains.add(skip)
    parts.append(page[at:])
    end()
    return verdicts(out, found, mains)


def verdicts(lines: list[tuple[str, bool, int]], found: list[tuple[int, bool, bool]], mains: set[int]) -> list[tuple[str, bool, bool]]:
    """Lines with their innermost element to skip -> with whether they are skipped.
    Elements come after those around them, so each is looked at once a direction."""
    by_tag, by_answer = [], []  # whether an element or one around it is skipped by its tag, is of answers
    for around, tag, answers in found:
        by_tag.append(tag or (around >= 0 and by_tag[around]))
        by_answer.append(answers or (around >= 0 and by_answer[around]))
    total = article = 0
    held, marked, main = [0] * len(found), [0] * len(found), [k in mains for k in range(len(found))]
    for text, within, k in lines:
        article += len(text) * (within and not (k >= 0 and by_answer[k]))
        total += len(text) * (not (k >= 0 and by_tag[k]))
        if k >= 0:
            held[k] += len(text)
            marked[k] += len(text) * within
    for k in range(len(found) - 1, -1, -1):
        if (around := found[k][0]) >= 0:
            held[around] += held[k]
            marked[around] += marked[k]
            main[around] = main[around] or main[k]
    gone: list[bool] = []
    for k, (around, tag, answers) in enumerate(found):
        stays = main[k] or (not answers and (marked[k] >= article if article else not tag and 2 * held[k] > total))
        gone.append(not stays or (around >= 0 and gone[around]))
    return [(text, within, k >= 0 and gone[k]) for text, within, k in lines]


def common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common_places(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in a of a longest common subsequence of a and b, by halving a; memory
    grows with the lengths' sum and time with their product."""
    out, todo = [], [(0, a, b)]
    while todo:
        at, a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) == 1:
            out += [at] if (b == a[0]).any() else []
            continue
        half = len(a) // 2
        k = int(np.argmax(common_lengths(a[:half], b) + common_lengths(a[half:][::-1], b[::-1])[::-1]))
        todo += [(at, a[:half], b[:k]), (at + half, a[half:], b[k:])]
    return out


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a are in the longest common subsequence of a and b. Common ends
    are cut off first."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    number = {s: i for i, s in enumerate(set(x) & set(y))}
    keep = np.array([i for i, s in enumerate(x) if s in number], int)  # others can't be shared
    middle = np.zeros(len(x), bool)
    if len(keep):
        middle[keep[common_places(np.array([number[x[i]] for i in keep]), np.array([number[s] for s in y if s in number]))]] = True
    return [True] * lo + middle.tolist() + [True] * hi


def squeeze(batches):
    """The html as zstd-compressed bytes, for the shuffle."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        z = [None if h is None else press(h.encode("utf-8", "surrogatepass")) for h in b.column("html").to_pylist()]
        names = ["row", "host", "path", "key", "tie"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(z, pa.binary())], [*names, "z"])


Lines = list[tuple[str, bool, bool]]


def template_ends(own: list[str], others: list[list[str]]) -> tuple[int, int]:
    """How many lines at the start and at the end of an article are a template: each
    stands at the same place from that end in three different articles or more, and in most."""
    counts, others = [], [list(x) for x in dict.fromkeys(map(tuple, others))]
    for way in (1, -1):
        n = 0
        while n < len(own):
            same = sum(len(x) > n and x[::way][n] == own[::way][n] for x in others)
            if same < 3 or 2 * same <= len(others):
                break
            n += 1
        counts.append(n)
    return counts[0], counts[1] if sum(counts) <= len(own) else len(own) - counts[0]


def main_lines(own: Lines, before: list[Lines], after: list[Lines]) -> str:
    """A page's main text, given the lines of the pages before and after it, nearest first.

    Skipped elements take no part, the page's or its neighbours'. On each side the nearest
    page that isn't a copy decides which lines outside a marked article go: those that it
    shares. A copy shares more than half of the article's lines or, where none is marked,
    of all lines. If all pages near look like copies, the lines go that every one of them
    shares, if there are three or more that don't hold the whole page: a template longer
    than the text.

    Within a marked article, pages share sentences too, so that a shared line alone is no
    template: of the lines that the deciding pages share, those go that begin or end the
    article of most pages near that aren't copies. Lines outside a marked article also go
    if a copy of it shares them. Where nothing was near, only the article stays, if it
    holds most of the text.
    """
    own, before, after = [x for x in own if not x[2]], *[[[x for x in page if not x[2]] for page in side] for side in (before, after)]
    texts = [t for t, _, _ in own]
    within = [inside for _, inside, _ in own]
    marked = any(within)
    body = within if marked else [True] * len(own)
    gone, copies, differing = [False] * len(own), {}, []
    compared = different = False
    for side in (before, after):
        decided = False
        for page in side:
            if not page:
                continue
            compared = True
            other = [t for t, _, _ in page]
            shared = shared_lines(texts, other)
            if 2 * sum(s and x for s, x in zip(shared, body, strict=True)) <= sum(body):
                differing.append([t for t, inside, _ in page if inside])
                if not decided:
                    gone = [g or s for g, s in zip(gone, shared, strict=True)]
                    decided = different = True
            elif not decided:
                copies[tuple(other)] = shared
    if marked:
        head, tail = template_ends([t for t, x in zip(texts, within, strict=True) if x], differing)
        at = np.cumsum(within)  # from 1, for the article's lines
        ends = [bool(x) and (k <= head or k > sum(within) - tail) for k, x in zip(at.tolist(), within, strict=True)]
        gone = [g and (not x or e) for g, x, e in zip(gone, within, ends, strict=True)]
        for shared in copies.values():
            gone = [g or (s and not x) for g, s, x in zip(gone, shared, within, strict=True)]
    if not different and not marked:
        partial = [shared for shared in copies.values() if not all(shared)]
        if len(partial) > 2:
            gone = [g or all(s) for g, s in zip(gone, zip(*partial, strict=True), strict=True)]
    if marked and not compared:
        size = sum(map(len, texts))
        if 2 * sum(len(t) for t, x in zip(texts, within, strict=True) if x) > size:
            gone = [not x for x in within]
    return "\n".join(t for t, g in zip(texts, gone, strict=True) if not g)


#: Pages on each side among which one that isn't a copy is looked for.
NEAR = 4


def edge_rows(batches):
    """Pages of a partition in order -> those whose neighbours may be in other
    partitions (own), and the pages these need from here."""
    names = ["row", "host", "path", "key", "tie", "z"]
    head, tail, seen = [], deque(maxlen=2 * NEAR), 0
    for b in batches:
        for i in range(b.num_rows):
            if seen < 2 * NEAR:
                head.append(b.slice(i, 1))
            tail.append((seen, b.slice(i, 1)))
            seen += 1
    rows = [*enumerate(head), *[x for x in tail if x[0] >= len(head)]]
    for i, x in rows:
        own = i < NEAR or i >= seen - NEAR
        yield pa.RecordBatch.from_arrays([*[x.column(c) for c in names], pa.array([own])], [*names, "own"])


def stream_rows(edges: bool):
    """Pages in the order of host, path, key and tie -> their main text.

    Of a partition of all pages, those at its edges are left out; of the pages
    at the edges (edges), those that only serve others.
    """

    def lines_of(z):
        import zstandard

        return page_lines("" if z is None else zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass"))

    def pages(batches):
        for b in batches:
            cols = [b.column(c) for c in ("host", "z")]
            flags = b.column("own").to_pylist() if edges else [True] * b.num_rows
            for i in range(b.num_rows):
                lines = lines_of(cols[1][i].as_py())
                yield b.column("row").slice(i, 1), cols[0][i].as_py(), lines, flags[i]

    def go(batches):
        held, texts = [], []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(held), pa.array(texts, pa.string())], ["row", "main_text"])
            held.clear(), texts.clear()
            return out

        for i, n_after, before, now, after in _around(pages(batches), NEAR):
            row, host, lines, mine = now
            if mine if edges else i >= NEAR and n_after >= NEAR:
                held.append(row)
                texts.append(main_lines(lines, *[[x[2] for x in side if x[1] == host and host] for side in (before, after)]))
            if len(held) >= 256:
                yield flush()
        if held:
            yield flush()

    return go


def _around(items, n: int):
    """(position, number after, up to n before, item, up to n after), nearest first."""
    before, ahead, i = deque(maxlen=n), deque(), 0
    items = iter(items)
    while True:
        while len(ahead) <= n and (x := next(items, None)) is not None:
            ahead.append(x)
        if not ahead:
            return
        now = ahead.popleft()
        yield i, len(ahead), list(before), now, list(ahead)
        before.appendleft(now)
        i += 1


def main_text(pages: DataFrame, url: str = "url", html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of ``pages`` (all but the html by default) with main_text.

    Neighbours of a page are up to NEAR before and after it among its host's, by path
    and then by a hash; hosts are compared without case and without www.

    Cases: a null html is empty and gives an empty text; pages whose url is null
    or has no host have no neighbours; a host's only page has none; repeated pages
    are copies of each other and keep their lines; an empty table gives an empty
    result; a carried column named main_text is replaced.
    """
    carry = [c for c in (pages.columns if carry is None else carry) if c not in ("main_text", *([html] if carry is None else []))]
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    row = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row")
    body = F.col(f"`{html}`").cast("string")
    # rows with equal address and html are told apart, as both passes must sort them alike
    tie = F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in carry if not any(x in pages.schema[c].dataType.simpleString() for x in ("map<", "variant"))])
    rows = pages.select(row, host.alias("host"), path.alias("path"), F.xxhash64(address, body).alias("key"), tie.alias("tie"), body.alias("html"))
    order = ["host", "path", "key", "tie"]
    kind = T.StructType([rows.schema["row"], T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("key", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("z", T.BinaryType())])
    n = max(1, -(-pages.count() // SLICE))
    # a large host goes to many tasks, as pages are dealt out by (host, path) ranges
    dealt = rows.mapInArrow(squeeze, kind).repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = T.StructType([rows.schema["row"], T.StructField("main_text", T.StringType())])
    inner = dealt.mapInArrow(stream_rows(False), made)
    # the few pages at the partitions' edges find their neighbours among each other
    ends = dealt.mapInArrow(edge_rows, T.StructType([*kind.fields, T.StructField("own", T.BooleanType())]))
    ends = ends.repartition("host").sortWithinPartitions(*order).mapInArrow(stream_rows(True), made)
    return inner.union(ends).select(*[F.col(f"row.`{c}`").alias(c) for c in carry], "main_text")


#: Pages that a task holds in order.
SLICE = 512
