"""Main text of web pages by wrapper induction.

The pages of a host are folded into one template: page trees are aligned with it by simple tree matching (the largest common top-down match that
keeps the order of children), matched nodes merge, unmatched ones are inserted.  Each page is then aligned with its host's template, which names
the slots of its texts, and the pages of each slot and text are counted.  A text that at least
half of a host's pages hold in the same slot is template; what varies is content.  Partial templates are made where the pages lie and merged in
two steps, and counts are sums, so a host with very many pages is no single task's work.  What a template has no room for is counted by its path.
Slots are then read by role: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments, told by element or role, hold no main text; if a page marks its article, only that does.
Class names are evidence only: a name counts if it is such a word, or made of such words and words of layout alone (site-footer, but not no-sidebar
or share-price), and never for an element that holds more than half of the page's text.
A page whose content would all be template (copies of one article) keeps it, and so does a marked article that would lose most of its text.

Defined results: null and empty pages, and pages without content, give the empty text; a null or unreadable address is a host of its own;
repeated rows give equal texts; other columns pass through, but a column of the text's name is replaced.  Hosts with fewer than `least` pages have no
template texts.  Elements nested deeper than DEEPEST hang in the tree at that depth, as in browsers; their texts stay in place.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.tables import settled

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object canvas title textarea xmp noembed noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option select button".split())
ENDS_P = BLOCKS - {"option", "select", "button", "html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: What an element of the key closes if it is open inside the nearest of the named scopes.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ELEMENTS = set("nav footer aside form head menu select button input dialog search fieldset label".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of class names that tell what holds no main text (fixed values).
NAMES = re.compile(r"^(?:ads?|advert.*|adsense|adbox|banner|sponsor.*|promo.*|sidebar|side|aside|menu|navbar|nav|navigation|breadcrumbs?|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|recommend.*|comments?|commentlist|disqus|replies|reply|respond|footer|foot|masthead|widget|toolbar|pagination|pager|hidden|copyright|legal|disclaimer|login|signup|search|searchbox)$")
HEADERS = re.compile(r"^(?:header|head|topbar|masthead)$")
#: Words of layout that may stand beside them in a name, and words about an article that are no evidence inside one (fixed values).
LAYOUT = re.compile(r"^(?:[0-9]+|area|bar|block|bottom|box|btn|button|buttons|col|column|container|content|fixed|float|form|global|group|icon|icons|inner|item|items|l|left|link|links|list|main|mobile|outer|page|pane|panel|post|posts|primary|r|right|row|secondary|section|site|slot|sticky|text|title|top|unit|wrap|wrapper|zone)$")
ABOUT = re.compile(r"^(?:legal|disclaimer|copyright|notice|alert)$")
PART = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
#: Depth of a tree.
DEEPEST = 256
REGIONS = {"article", "main"}
#: Bound of a template's nodes.
NODES = 400


class Node:
    """An element: label (element and class), children, hashes of its blocks' texts, pages that have it."""

    __slots__ = ("label", "tag", "drop", "children", "texts", "pages")

    def __init__(self, label: str, tag: str, drop: bool):
        self.label, self.tag, self.drop, self.children, self.texts, self.pages = label, tag, drop, [], set(), 1


def telling(names: str, inside: bool) -> bool:
    """Whether one of the class names or ids says that an element holds no main text."""
    for name in names.split():
        parts = [x for x in PART.split(name) if x]
        parts = [x.lower() for x in parts]
        whole = "".join(parts)
        told = [bool(NAMES.match(x) or (not inside and HEADERS.match(x))) and not (inside and ABOUT.match(x)) for x in parts]
        if (any(told) and all(t or LAYOUT.match(x) for t, x in zip(told, parts, strict=True))) or (NAMES.match(whole) and not (inside and ABOUT.match(whole))):
            return True
    return False


def _told(tag: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """The element's label, whether it holds no main text, and whether its names say so."""
    named = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes and attributes.strip() else {}
    drop = tag in ELEMENTS or (tag == "header" and not inside) or named.get("role", "").lower() in ROLES
    said = False
    if named or attributes:
        if tag not in ("html", "body", "main") and not (tag == "article" and not inside):
            said = telling(f"{named.get('class', '')} {named.get('id', '')}", inside)
        drop |= named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").replace(" ", "").lower() or bool(BARE_HIDDEN.search(attributes) and "hidden" not in named.get("class", ""))
    return (f"{tag}.{named.get('class', '')}" if named.get("class") else tag), drop, said and not drop


def parse(page: str) -> tuple[Node, list[tuple[Node, str, bool, bool]]]:
    """The page's tree, and its blocks in order: element, text, whether inside an article, whether kept by role."""
    root = Node("#", "#", False)
    stack: list[tuple[Node, bool, bool, int]] = [(root, False, True, -1)]  # element, inside an article, main text so far, nearest telling name
    blocks: list[tuple[Node, str, bool, bool, int]] = []
    above: list[int] = []  # of each element with a telling name, the one around it
    run: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        if run:
            if text := " ".join(entities.unescape("".join(run)).split()):
                k = len(stack) - 1
                while k and stack[k][0].tag not in BLOCKS:
                    k -= 1
                blocks.append((stack[min(k, DEEPEST)][0], text, *stack[-1][1:]))
            run.clear()

    def pop_to(k: int) -> None:
        flush()
        del stack[k:]

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                run.append(s)
            elif s.startswith("<![CDATA["):
                run.append(entities.escape(s[9:-3]))
            continue
        tag, attributes = name.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:  # an end
            if tag == "br":
                run.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0].tag == tag:
                    if tag in BLOCKS or stack[k][0].drop:
                        pop_to(k)
                    else:
                        del stack[k]
                    break
                if stack[k][0].tag in BLOCKS and tag not in BLOCKS:
                    break
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                found = re.compile(f"</{tag}", re.I).search(page, at)
                close = found.start() if found else -1
                at = end if close < 0 else (page.find(">", close) + 1 or end)
            continue
        if tag in ("br", "wbr", "img"):
            run.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0].tag == "p":
                        pop_to(k)
                        break
                    if stack[k][0].tag in BLOCKS:
                        break
            if tag in CLOSES:
                what, scope = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0].tag in scope:
                        break
                    if stack[k][0].tag in what:
                        pop_to(k)
                        break
        if tag in VOID or (tag in ("html", "body") and any(x[0].tag == tag for x in stack)):
            continue
        if tag == "body":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0].tag == "head":
                    pop_to(k)
                    break
        _, inside, main, name = stack[-1]
        label, drop, said = _told(tag, attributes, inside)
        node = Node(label, tag, drop or said)
        if (drop or said) and main:
            flush()
        if tag in BLOCKS or drop or said:
            stack[min(len(stack) - 1, DEEPEST)][0].children.append(node)
        if said:
            above.append(name)
            name = len(above) - 1
        stack.append((node, inside or (tag in REGIONS and main and not drop), main and not drop, name))
    pop_to(1)
    # What a name says is believed unless its element holds most of the text.
    held = [0] * len(above)
    for _, text, _, main, name in blocks:
        if main and name >= 0:
            held[name] += len(text)
    for k in range(len(above) - 1, -1, -1):
        if above[k] >= 0:
            held[above[k]] += held[k]
    total = sum(len(text) for _, text, _, main, _ in blocks if main)
    out = [False] * len(above)
    for k, parent in enumerate(above):
        out[k] = 2 * held[k] <= total or (parent >= 0 and out[parent])
    return root, [(node, text, inside, main and not (name >= 0 and out[name])) for node, text, inside, main, name in blocks]


def matched(a: Node, b: Node) -> int:
    """Size of the largest top-down match of two trees that keeps the order of children."""
    if a.label != b.label:
        return 0
    if not a.children or not b.children:
        return 1
    row = [0] * (len(b.children) + 1)
    for x in a.children:
        new = [0]
        for j, y in enumerate(b.children):
            new.append(max(row[j + 1], new[j], row[j] + matched(x, y) if x.label == y.label else 0))
        row = new
    return 1 + row[-1]


def aligned(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of children in the best match of two lists."""
    if [x.label for x in a] == [y.label for y in b]:
        return [(k, k) for k in range(len(a))]
    table = [[0] * (len(b) + 1)]
    gain = {}
    for i, x in enumerate(a):
        table.append([0])
        for j, y in enumerate(b):
            gain[i, j] = matched(x, y) if x.label == y.label else 0
            table[-1].append(max(table[-2][j + 1], table[-1][j], table[-2][j] + gain[i, j]))
    out, i, j = [], len(a), len(b)
    while i and j:
        if gain[i - 1, j - 1] and table[i][j] == table[i - 1][j - 1] + gain[i - 1, j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def merge(into: Node, other: Node, room: int) -> int:
    """Fold another tree of the same label into a template; returns how many more nodes there is room for."""
    into.pages += other.pages
    into.texts |= other.texts
    pairs = aligned(into.children, other.children)
    mate = {j: i for i, j in pairs}
    children, at = [], 0
    for j, y in enumerate(other.children):
        if j in mate:
            children += into.children[at : mate[j] + 1]
            at = mate[j] + 1
            room = merge(children[-1], y, room)
        elif room > 0:
            room -= _nodes(y)
            children.append(y)
    into.children = children + into.children[at:]
    return room


def _nodes(n: Node) -> int:
    return 1 + sum(map(_nodes, n.children))


def folded(n: Node) -> Node:
    """Runs of like siblings as one node, which holds the texts of all."""
    children: list[Node] = []
    for c in map(folded, n.children):
        if children and children[-1].label == c.label:
            last = children[-1]
            merge(last, c, NODES)
            last.pages = 1
        else:
            children.append(c)
    n.children = children
    return n


def _hash(text: str) -> int:
    return crc32(text.encode()) << 20 | len(text) & 0xFFFFF


def template_of(page: str) -> Node:
    return folded(parse(page)[0])


def _dump(n: Node) -> list:
    return [n.label, n.pages, [_dump(c) for c in n.children]]


def _load(x: list) -> Node:
    n = Node(x[0], "", False)
    n.pages, n.children = x[1], [_load(c) for c in x[2]]
    return n


def _paths(root: Node) -> dict[int, str]:
    """Labels from the root down to each node, by the node's id()."""
    path: dict[int, str] = {}

    def walk(n: Node, above: str) -> None:
        path[id(n)] = here = f"{above}/{n.label}"
        for c in n.children:
            walk(c, here)

    walk(root, "")
    return path


def slots(page: str, template: Node) -> set[tuple[str, str]]:
    """Path and text, and the template's slot, of all texts of a page; no slot for what the template doesn't have."""
    root, blocks = parse(page)
    path = _paths(root)
    every = set()
    for node, text, _, main in blocks:
        if main and id(node) in path:
            node.texts.add(_hash(text))
            every.add(f"{path[id(node)]} {_hash(text)}")
    found: set[tuple[str, str]] = set()

    def walk(n: Node, like: Node | None, above: str, slot: str) -> None:
        here = f"{above}/{n.label}"
        found.update((f"{here} {text}", slot) for text in n.texts)
        mate = {j: i for i, j in aligned(like.children, n.children)} if like else {}
        for j, c in enumerate(n.children):
            if j in mate:
                walk(c, like.children[mate[j]], here, f"{slot}.{mate[j]}")
            else:
                walk(c, None, here, "")

    walk(folded(root), template, "", "0")
    return found | {(x, "") for x in every - {x for x, _ in found}}


def extract(page: str | None, template: set[str]) -> str:
    """The page's main text."""
    if not page:
        return ""
    root, blocks = parse(page)
    marked = any(inside and main for _, _, inside, main in blocks)
    kept = [(n, text) for n, text, inside, main in blocks if main and (inside or not marked)]
    if template:
        path = _paths(root)
        varying = [(n, text) for n, text in kept if f"{path.get(id(n), '')} {_hash(text)}" not in template]
        size = lambda blocks: sum(len(text) for _, text in blocks)
        if varying and not (marked and 2 * size(varying) < size(kept)):
            kept = varying
    return "\n\n".join(text for _, text in kept)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, least: int = 8, salts: int = 64) -> DataFrame:
    """pages: host, html.  Returns host, template: the template texts of each host with at least `least` pages."""
    partial = "host string, salt int, tree string"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Node] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, TaskContext.get().partitionId() % salts, json.dumps(_dump(t), separators=(",", ":"))) for h, t in trees.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["host", "salt", "tree"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page:
                    tree = template_of(page)
                    if host in trees:
                        merge(trees[host], tree, NODES - _nodes(trees[host]))
                    else:
                        trees[host] = tree
            if len(trees) > 2000:
                yield out()
                trees = {}
        yield out()

    def join(key, group: pd.DataFrame) -> pd.DataFrame:
        trees = [_load(json.loads(x)) for x in group["tree"].sort_values()]
        for t in trees[1:]:
            merge(trees[0], t, NODES - _nodes(trees[0]))
        return pd.DataFrame({"host": [key[0]], "salt": [0], "tree": [json.dumps(_dump(trees[0]), separators=(",", ":"))]})

    def finish(key, group: pd.DataFrame) -> pd.DataFrame:
        tree = join(key, group)["tree"][0]
        return pd.DataFrame({"host": [key[0]], "pages": [_load(json.loads(tree)).pages], "tree": [tree]})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, tree = None, None
        for batch in batches:
            out = []
            for host, n, page, own in zip(*(batch.column(c).to_pylist() for c in ("host", "pages", "html", "tree")), strict=True):
                if own != text:
                    text, tree = own, _load(json.loads(own))
                out += [(host, n, *x) for x in slots(page, tree)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["host", "pages", "item", "slot"])

    first = pages.mapInArrow(learn, partial)
    second = first.groupBy("host", "salt").applyInPandas(join, partial)
    trees = settled(second.groupBy("host").applyInPandas(finish, "host string, pages long, tree string").filter(F.col("pages") >= least))
    held = pages.filter("html <> ''").join(trees, "host").select("host", "pages", "html", "tree").mapInArrow(named, "host string, pages long, item string, slot string")
    constant = held.groupBy("host", "pages", "item", "slot").count().filter(2 * F.col("count") >= F.col("pages"))
    return constant.groupBy("host").agg(F.collect_set("item").alias("template"))


def main_text(pages: DataFrame, *, url: str = "url", html: str = "html", text: str = "text", least: int = 8) -> DataFrame:
    """pages with the main text of each page in column `text`."""
    pages = pages.drop(text)
    known = settled(templates(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")), least).filter(F.size("template") > 0))
    names = pages.columns
    # Names that no column of the caller's has.
    taken = {n.lower() for n in [*names, text]}
    host, template = (next(f"{n}{k}" for k in range(len(taken) + 1) if f"{n}{k}" not in taken) for n in ("host_", "template_"))
    both = pages.withColumn(host, host_of(F.col(url))).join(known.select(F.col("host").alias(host), F.col("template").alias(template)), host, "left").select(*names, template)
    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(p, set(t or ())) for p, t in zip(batch.column(html).to_pylist(), batch.column(template).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.string())], names=[*names, text])

    return both.mapInArrow(run, schema)
