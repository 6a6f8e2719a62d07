"""Operator 1, HTML extraction by wrapper induction.

1. Every page becomes a tree of its block elements (inline tags are transparent) with the text blocks at its nodes.  Runs of
   equal sibling subtrees (by hash) fold into one, so pages that differ in the number of paragraphs have one skeleton.  Pages carry its
   hash; its outline, a line per node, is kept once for each host.
2. Per host the most frequent skeleton is the reference.  Every other skeleton of the host is aligned with it by simple tree
   matching (the largest common tree that keeps labels, order and ancestry).  A node has two places: its node in the reference, if
   any, and its path of labels with the number of each among its siblings (neighbours of one label count once), which needs no skeleton.
3. Each place has the count of the text hashes of its blocks (a folded run has those of all its siblings) over the different pages
   of the host.  A text on ``MIN_PAGES`` or more of them and on ``SHARE`` percent of those with the place is template; what varies is
   a slot.  Pages are the same if their longest blocks, together ``SAME`` percent of the text, are equal: copies count once, also
   copies with another date or counter.
4. A page's text is its slots in the zone of the article, by page order: the blocks below ``article`` or ``main`` if they have
   text, else those outside that are not mostly links; navigation, headers, footers, asides and forms are never content.  Elements
   whose class, id or role names a notice, advert, comment or the like are content only where the rest of the zone has less text than
   they (comments: no text); such names count as whole names and never on ``article`` and ``main``.

Statistics are distinct (host, place, text hash, page) and their counts, combined before each shuffle, so a host with a third of all
pages is no larger a row than any other.

Defined results: NULL and empty html and pages without text give the empty text.  Pages without a host in their url share the
empty host.  Repeated pages add nothing to the statistics.  Unclosed elements end with their parent, an unfinished
tag at the end is dropped.  Nesting of any depth and any number of siblings take time and memory in proportion to the page, but for the
time to match unlike lists of siblings, which grows with the product of their lengths.  On hosts with
fewer than ``MIN_PAGES`` different pages nothing is template.  Empty tables give empty results; clashing input columns are replaced.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.llm import text as T
from gradelens.llm.arrow import add_columns, map_batches
from gradelens.llm.shared import stored

#: Parameter: different pages of a host that must agree before a node is template.
MIN_PAGES = 8
#: Parameter: percent of the different pages with a place that must agree before a text is template: sentences that
#: articles of a host have in common are on less (41 % of a host in check_h, 16 % in sf0.1), notices of one layout on more.
SHARE = 50
#: Parameter: percent of a page's text that makes it the same page.
SAME = 95
#: Parameter: pairs of siblings from which a matching takes vectors; the results are the same.
PLAIN = 1024

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object select".split())
BLOCK = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table div section article main body".split())
NEVER = frozenset("nav footer aside form menu dialog button select".split())
MAIN = frozenset("article main".split())
# Words of class, id and role that mark what is not the article.
NEVER_WORDS = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget ad ads advert adverts advertisement
adsense sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup social share sharing related
recommended comment comments disqus reply replies respond login search searchform pagination pager toolbar copyright contentinfo complementary alert
skip hidden""".split())
HEAD_WORDS = frozenset("header banner".split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: Words that leave the meaning of a name with one of the above (top-menu, comments-area).
PLACE_WORDS = frozenset("top bottom left right main site page global primary secondary area bar block box container inner list outer section wrap wrapper".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+>?""", re.S)
MARKS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
OFF = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
RAW_END = {t: re.compile(rf"</{t}\s*+[^>]*+>", re.I) for t in RAW}


@functools.lru_cache(maxsize=4096)
def marks(tag: str, attrs: str) -> tuple[str, bool, int, int, bool]:
    """(label, never content, mark by names, mark by names of headers, main) of an element."""
    words, mark, head, main = set(), UNMARKED, UNMARKED, tag in MAIN
    for m in MARKS.finditer(attrs):
        for name in m[2].lower().strip("\"'").split():
            parts = {w for w in re.split(r"[^a-z]+", name) if w}
            words |= parts
            if tag in MAIN:
                continue
            hits = parts & NEVER_WORDS
            if hits and parts <= NEVER_WORDS | PLACE_WORDS:
                mark = max(mark, COMMENTS if hits & COMMENT_WORDS else MARKED)
            elif parts & HEAD_WORDS and parts <= HEAD_WORDS | PLACE_WORDS:
                head = MARKED
            else:
                main = main or "main" in parts
    off = OFF.search(attrs) if "display" in attrs.lower() else OFF.search(re.sub(r"""(?i)(?<!aria-hidden)=\s*("[^"]*"|'[^']*')""", "=x", attrs))
    return tag + "".join("." + w for w in sorted(words)), tag in NEVER or bool(off), mark, head, main


class Node:
    __slots__ = ("tag", "label", "zone", "mark", "children", "canon", "size", "slot", "path")

    def __init__(self, tag, label, zone, mark=0):
        self.tag, self.label, self.zone, self.mark = tag, label, zone, mark
        self.children, self.canon, self.size, self.slot, self.path = [], 0, 1, 0, PATHS


#: Paths are hashes from here on; the reference's nodes have the numbers below.
PATHS = 1 << 32


#: Zones of a node: never content, in an article, elsewhere.
NEVER_ZONE, MAIN_ZONE, OTHER_ZONE = 0, 1, 2
#: Marks of a node by names, its own or above.
UNMARKED, MARKED, COMMENTS = 0, 1, 2


def parse(page: str) -> tuple[Node, list[tuple[Node, str, bool]]]:
    """(root, blocks): a block is (node, text, mostly links), in page order."""
    root = Node("", "", OTHER_ZONE)
    stack, blocks, parts = [root], [], []
    places: dict[str, list[int]] = {}       # where each tag is open on the stack
    scopes = [0]
    linked, depth, pos = 0, 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((stack[-1], text, linked * 5 > 4 * len(text)))
            parts.clear()
        linked = 0

    def pop_to(n):
        flush()
        for node in stack[n:]:
            places[node.tag].pop()
        while scopes[-1] >= n > 0:
            scopes.pop()
        del stack[n:]

    for m in iter(lambda: TAG.search(page, pos), None):
        start = m.start()
        if start > pos:
            piece = page[pos:start]
            if "&" in piece:
                piece = entities.unescape(piece)
            parts.append(piece)
            if depth:
                linked += len(piece)
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag not in BLOCK:
            if tag in RAW and not closing:
                if not attrs.endswith("/"):
                    end = RAW_END[tag].search(page, pos)
                    pos = end.end() if end else len(page)
            elif tag == "a":
                depth = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            elif tag == "head" and closing:
                flush()
            elif tag == "button" and not closing:
                end = re.compile(r"</button\s*>", re.I).search(page, pos)
                pos = end.end() if end else pos
            continue
        if closing:
            if places.get(tag):
                pop_to(places[tag][-1])
            else:
                flush()
            continue
        depth = 0
        if tag in ("html", "body"):
            flush()
            continue
        # the innermost open paragraph or element that this one closes, unless a scope is open inside it
        n = max((places[t][-1] for t in ("p", *CLOSED_BY.get(tag, ())) if places.get(t)), default=0)
        if n > scopes[-1]:
            pop_to(n)
        flush()
        if tag == "hr":
            continue
        label, never, mark, head, main = marks(tag, attrs if "=" in attrs or "hidden" in attrs else "")
        above = stack[-1].zone
        if above == NEVER_ZONE or never or (tag == "header" and above != MAIN_ZONE):
            zone = NEVER_ZONE
        else:
            zone = MAIN_ZONE if above == MAIN_ZONE or main else OTHER_ZONE
        node = Node(tag, label, zone, max(stack[-1].mark, mark, head if above != MAIN_ZONE else UNMARKED))
        stack[-1].children.append(node)
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append(node)
    tail = page[pos:]
    parts.append(entities.unescape(tail) if "&" in tail else tail)
    pop_to(1)
    flush()
    return root, blocks


def fold(root: Node) -> None:
    """Hashes of the skeletons bottom up (equal neighbours fold), then slot numbers: the preorder place in the folded tree, and paths."""
    order = [root]
    for node in order:
        order.extend(node.children)
    for node in reversed(order):
        size, last = 1, None
        own = xxhash.xxh3_64(node.label.encode())
        own.update(b"=m~"[node.zone:node.zone + 1])
        for c in node.children:
            if c.canon != last:
                own.update(c.canon.to_bytes(8, "little"))
                size += c.size
                last = c.canon
        node.canon, node.size = own.intdigest(), size
    for node in order:
        at, last = node.slot + 1, None
        runs, label = {}, None
        for c in node.children:
            if c.label != label:
                label = c.label
                runs[label] = runs.get(label, 0) + 1
            c.path = path_hash(node.path, label, runs[label])
            if c.canon == last:
                c.slot = place
                continue
            c.slot = place = at
            at, last = at + c.size, c.canon


def outline(root: Node) -> str:
    """The folded skeleton: a line ``depth label`` with the zone's mark per node, in preorder."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        out.append(f"{depth} {node.label}{'=m~'[node.zone]}")
        last, kept = None, []
        for c in node.children:
            if c.canon != last:
                kept.append((c, depth + 1))
                last = c.canon
        todo.extend(reversed(kept))
    return "\n".join(out)


def tree(lines: str) -> tuple[list[str], list[list[int]]]:
    """(labels, children) of an outline, in preorder."""
    labels, children, open_ = [], [], []
    for line in lines.split("\n"):
        depth, label = line.split(" ", 1)
        d = int(depth)
        del open_[d:]
        if open_:
            children[open_[-1]].append(len(labels))
        open_.append(len(labels))
        labels.append(label)
        children.append([])
    return labels, children


def node_paths(labels: list[str], children: list[list[int]]) -> list[int]:
    """The path of every node of an outline, as ``fold`` gives it."""
    out = [PATHS] * len(labels)
    for node, kids in enumerate(children):      # preorder: a parent is before its children
        runs, label = {}, None
        for c in kids:
            own = labels[c][:-1]
            if own != label:
                label = own
                runs[label] = runs.get(label, 0) + 1
            out[c] = path_hash(out[node], label, runs[label])
    return out


def shapes(labels: list[str], children: list[list[int]], known: dict) -> tuple[list[int], list[int], list[int]]:
    """(shape, height, size) of every node: nodes of one shape have equal subtrees; ``known`` numbers the shapes of several trees."""
    n = len(labels)
    shape, height, size = [0] * n, [0] * n, [1] * n
    for x in range(n - 1, -1, -1):      # preorder: children are behind their parent
        shape[x] = known.setdefault((labels[x], *[shape[c] for c in children[x]]), len(known))
        for c in children[x]:
            height[x] = max(height[x], height[c] + 1)
            size[x] += size[c]
    return shape, height, size


def align(reference: str, lines: str) -> list[int]:
    """For each node of an outline the node of the reference that simple tree matching gives it, or -1.

    Subtrees of equal shape are matched once, whatever their number, and only below parents of one label; a pair of sibling lists takes a
    vector operation per sibling (``matched``).
    """
    (la, ca), (lb, cb) = tree(reference), tree(lines)
    if not la or not lb or la[0] != lb[0]:
        return [-1] * len(lb)
    known: dict[tuple, int] = {}
    sa, ha, na = shapes(la, ca, known)
    sb, _, nb = shapes(lb, cb, known)
    kids_a, kids_b = {s: [sa[c] for c in k] for s, k in zip(sa, ca)}, {s: [sb[c] for c in k] for s, k in zip(sb, cb)}
    label, height, size = dict(zip(sa, la)) | dict(zip(sb, lb)), dict(zip(sa, ha)), dict(zip(sa, na))
    # the pairs of unequal shapes that matching can meet, from the roots down
    pairs, todo = set(), [(sa[0], sb[0])] if sa[0] != sb[0] else []
    pairs.update(todo)
    while todo:
        x, y = todo.pop()
        mine: dict[str, list[int]] = {}
        for p in set(kids_a[x]):
            mine.setdefault(label[p], []).append(p)
        for q in set(kids_b[y]):
            for p in mine.get(label[q], ()):
                if p != q and kids_a[p] and kids_b[q] and (p, q) not in pairs:
                    pairs.add((p, q))
                    todo.append((p, q))
    best: dict[tuple[int, int], int] = {}

    def weight(p: int, q: int) -> int:
        """The largest common tree of two shapes of one label."""
        return size[p] if p == q else best.get((p, q), 1)

    for x, y in sorted(pairs, key=lambda s: height[s[0]]):      # bottom up, so no recursion on deep trees
        best[x, y] = 1 + sum(w for _, _, w in matched(kids_a[x], kids_b[y], label, weight, False))
    out, ways = [-1] * len(lb), {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        if sa[x] == sb[y]:
            out[y:y + nb[y]] = range(x, x + na[x])
            continue
        out[y] = x
        own = (sa[x], sb[y])
        if own not in ways:
            ways[own] = matched(kids_a[own[0]], kids_b[own[1]], label, weight, True)
        todo.extend((ca[x][i], cb[y][j]) for i, j, _ in ways[own])
    return out


def matched(one: list[int], two: list[int], label: dict[int, str], weight, path: bool) -> list[tuple[int, int, int]]:
    """The heaviest matching in order of two sibling lists, as (place, place, weight); of equal ones that with the last siblings. Without
    ``path`` one entry has the sum.

    Equal siblings at the end belong together in it. Of the table of the rest every ``step``-th row is held, and those between are made anew
    on the way back.
    """
    found, n, m = [], len(one), len(two)
    while n and m and one[n - 1] == two[m - 1]:
        n, m = n - 1, m - 1
        found.append((n, m, weight(one[n], two[m])))
    if not n or not m:
        return found
    if not path and n * m <= PLAIN:      # the same sums, without the cost of setting up vectors
        line, names = [0] * (m + 1), [label[q] for q in two[:m]]
        for p in one[:n]:
            name, before, now = label[p], 0, 0
            for j in range(m):
                above = line[j + 1]
                now = above if above > now else now
                if names[j] == name:
                    now = max(now, before + weight(p, two[j]))
                before, line[j + 1] = above, now
        return [*found, (-1, -1, line[m])]
    alike: dict[str, dict[int, list[int]]] = {}     # the places in two of each label and shape
    for j, q in enumerate(two[:m]):
        alike.setdefault(label[q], {}).setdefault(q, []).append(j)
    flat = {t: (list(own), np.repeat(np.arange(len(own)), [len(x) for x in own.values()]), np.array([j for x in own.values() for j in x])) for t, own in alike.items()}

    def following(row: np.ndarray, p: int) -> np.ndarray:
        if label[p] not in flat:
            return row
        kinds, kind, at = flat[label[p]]
        out = row.copy()
        out[at + 1] = np.maximum(row[at + 1], row[at] + np.array([weight(p, q) for q in kinds])[kind])
        return np.maximum.accumulate(out)

    step = int(n ** 0.5) + 1
    row, held = np.zeros(m + 1, np.int64), []
    for i in range(n):
        if path and i % step == 0:
            held.append(row)
        row = following(row, one[i])
    if not path:
        return [*found, (-1, -1, int(row[m]))]
    i, j = n, m
    while i and j:
        first = (i - 1) // step * step
        table = [held[first // step]]
        for p in one[first:i]:
            table.append(following(table[-1], p))
        while i > first and j:
            now, above, p, q = table[i - first], table[i - first - 1], one[i - 1], two[j - 1]
            w = weight(p, q) if label[p] == label[q] else 0
            if w and now[j] == above[j - 1] + w:
                i, j = i - 1, j - 1
                found.append((i, j, w))
            elif now[j] == above[j]:
                i -= 1
            else:
                j -= 1
    return found


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def article(blocks: list[tuple[Node, str, bool]]) -> list[tuple[Node, str]]:
    """The blocks below ``article`` or ``main``, else those outside, without marked ones unless these hold most of the text."""
    found = [(n, t) for n, t, links in blocks if n.zone == MAIN_ZONE or (n.zone == OTHER_ZONE and not links)]
    if any(n.zone == MAIN_ZONE and n.mark == UNMARKED for n, _ in found):
        found = [(n, t) for n, t in found if n.zone == MAIN_ZONE]
    size = [0, 0, 0]
    for n, t in found:
        size[n.mark] += len(t)
    most = UNMARKED if size[UNMARKED] >= max(size[MARKED], 1) else MARKED if size[MARKED] else COMMENTS
    kept = [(n, t) for n, t in found if n.mark <= most]
    return [(n, t) for n, t in kept if n.zone == MAIN_ZONE] or kept


@functools.lru_cache(maxsize=4096)
def path_hash(above: int, label: str, number: int) -> int:
    return text_hash(f"{above} {label} {number}") | PATHS


def page_view(url: str | None, page: str | None) -> tuple[str, Node, list[tuple[int, int, int, str]]]:
    """(host, root, content): content has (slot, path, text hash, text) of the article's zone."""
    root, blocks = parse(page or "")
    fold(root)
    return host_of(url), root, [(n.slot, n.path, text_hash(t), t) for n, t in article(blocks)]


def skeleton_of(root: Node) -> int:
    """The hash of a page's skeleton, as a long."""
    return root.canon >> 1


def page_key(texts: list[str]) -> int:
    """Hash of the longest texts that together are ``SAME`` percent of all: pages of one key are one page."""
    need, kept = SAME * sum(map(len, texts)), []
    for t in sorted(texts, key=lambda t: (-len(t), t)):
        if need <= 0:
            break
        need -= 100 * len(t)
        kept.append(t)
    return text_hash("\n".join(kept))


def page_rows(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, skeleton, outline, page, slots, paths, hashes) of each page with content; of equal skeletons that a batch meets on a host
    the first has the outline."""

    def run(batches):
        for b in batches:
            rows, known = [], set()
            for u, page in zip(b.column(0), b.column(1)):
                host, root, content = page_view(u.as_py(), page.as_py())
                if content:
                    own = (host, skeleton_of(root))
                    lines = None if own in known else outline(root)
                    known.add(own)
                    rows.append((*own, lines, page_key([c[-1] for c in content]), *([c[i] for c in content] for i in range(3))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                names=["host", "skeleton", "outline", "page", "slots", "paths", "hashes"])

    return map_batches(pages.select(F.col(url).alias("u"), F.col(html).alias("p")), run,
                       "host string, skeleton long, outline string, page long, slots array<int>, paths array<long>, hashes array<long>")


#: Stands for the text hash where all pages with a place are counted.
ANY = -1


def place_counts(placed: DataFrame, min_pages: int) -> DataFrame:
    """(host, place, hash, n): different pages with a text at a place, ``ANY`` for all pages with the place; ``min_pages`` at least."""

    def run(batches):
        for b in batches:
            rows = set()
            for host, page, slots, paths, hashes, places in zip(*(c.to_pylist() for c in b.columns)):
                for slot, path, h in zip(slots, paths, hashes):
                    rows.update(((host, path, h, page), (host, path, ANY, page)))
                    if places[slot] >= 0:
                        rows.update(((host, places[slot], h, page), (host, places[slot], ANY, page)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["host", "place", "hash", "page"])

    spots = map_batches(placed.select("host", "page", "slots", "paths", "hashes", "places"), run, "host string, place long, hash long, page long")
    return spots.groupBy("host", "place", "hash").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_pages)


def spot(place, text):
    return F.xxhash64(place.cast("long"), text)


def induce(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """The wrappers: (host, skeleton, places, template): the reference's node for each node, and the ``spot`` of each template text that
    one of the skeleton's own places has (two texts a place at most, since each is on half of its pages)."""
    seen = stored(page_rows(pages, url, html), "html-pages")
    counted = seen.groupBy("host", "skeleton").agg(F.count_distinct("page").alias("n"))
    outlines = seen.where(F.col("outline").isNotNull()).groupBy("host", "skeleton").agg(F.min("outline").alias("outline"))
    skeletons = stored(counted.join(outlines, ["host", "skeleton"]), "html-skeletons")
    reference = (skeletons.groupBy("host").agg(F.max_by("outline", F.struct("n", "skeleton")).alias("reference"), F.sum("n").alias("all"))
                 .where(F.col("all") >= min_pages).drop("all"))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        pairs = list(zip(T.column(batch, "reference"), T.column(batch, "outline")))
        return [pa.array([align(ref.as_py(), lines.as_py()) for ref, lines in pairs], pa.list_(pa.int32())),
                pa.array([node_paths(*tree(lines.as_py())) for _, lines in pairs], pa.list_(pa.int64()))]

    both = add_columns(skeletons.join(reference, "host"), {"places": "array<int>", "own": "array<bigint>"}, run)
    aligned = stored(both.select("host", "skeleton", "places", "own"), "html-aligned")
    counts = stored(place_counts(seen.drop("outline").join(aligned.drop("own"), ["host", "skeleton"]), min_pages), "html-counts")
    every = counts.where(F.col("hash") == ANY).select("host", "place", F.col("n").alias("all"))
    fixed = counts.where(F.col("hash") != ANY).join(every, ["host", "place"]).where(F.col("n") * 100 >= F.col("all") * SHARE).select("host", "place", "hash")
    spots = aligned.select("host", "skeleton", F.explode(F.array_distinct(F.concat(F.col("places").cast("array<bigint>"), "own"))).alias("place")).where("place >= 0")
    template = spots.join(fixed, ["host", "place"]).groupBy("host", "skeleton").agg(F.collect_set(spot(F.col("place"), F.col("hash"))).alias("template"))
    return aligned.drop("own").join(template, ["host", "skeleton"])


def extract(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars``."""
    wrappers = stored(induce(pages, url, html, min_pages), "html-wrappers")
    names = ["host", "skeleton", "slots", "paths", "hashes", "texts", "places", "template", "hits"]
    mark = "__"
    while any(c.lower().startswith(mark) and c.lower().lstrip("_") in names for c in pages.columns):
        mark += "_"
    col = {n: mark + n for n in names}

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        views = [page_view(u.as_py(), p.as_py()) for u, p in zip(T.column(batch, url), T.column(batch, html))]
        lists = [pa.array([[c[i] for c in v[2]] for v in views], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string()))]
        return [pa.array([v[0] for v in views], pa.string()), pa.array([skeleton_of(v[1]) for v in views], pa.int64()), *lists]

    kinds = ("string", "bigint", "array<int>", "array<bigint>", "array<bigint>", "array<string>")
    new = {col[n]: t for n, t in zip(names, kinds)}
    parsed = add_columns(pages, new, run).drop(html, "text", "n_chars")
    known = wrappers.select(*[F.col(n).alias(col[n]) for n in ("host", "skeleton", "places", "template")])
    joined = parsed.join(known, [col["host"], col["skeleton"]], "left")
    blocks = F.arrays_zip(*[F.col(col[n]).alias(n) for n in ("slots", "paths", "hashes", "texts")])
    spots = [lambda b: spot(F.get(col["places"], b["slots"]), b["hashes"]), lambda b: spot(b["paths"], b["hashes"])]
    found = joined.withColumn(col["hits"], F.array_intersect(F.concat(*(F.transform(blocks, at) for at in spots)), col["template"]))
    slots = F.filter(blocks, lambda b: ~(F.array_contains(col["hits"], spots[0](b)) | F.array_contains(col["hits"], spots[1](b))))
    pairs = F.when(F.size(col["hits"]) > 0, slots).otherwise(blocks)
    text = F.array_join(F.transform(pairs, lambda b: b["texts"]), "\n")
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).drop(*col.values())
