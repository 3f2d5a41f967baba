"""Main text of web pages, with wrappers inferred per host as union-free regular expressions.

1. A page is a stream of opened tags and texts. A text that most pages of its host have at the same place is
   part of the template; everywhere else texts differ, and the place is a slot.
2. A page's skeleton is that stream with neighbouring equal units folded into repeated groups. Skeletons of
   one host are aligned in turn: what all have stays, what only some have becomes an optional group, runs
   of a unit become a repeated group. The result is the host's wrapper. Equal skeletons count once, and
   wrappers of parts of a host align like skeletons, so a host of any size is folded in parts.
3. The wrapper says what is main: its fixed texts are template and go, and slots of mostly linked text are menus.
4. Each page chooses its own region, as a host may have many layouts: an article or main element with
   enough of its text, else all but the menus. Names of classes and ids settle what the wrapper leaves open:
   inside the region only names that are such a word by themselves count, outside also parts of them.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import stored
from tidemill.llm.text import slices

#: Skeletons, or wrappers of parts, that one task folds into one; a host of more goes through more rounds.
FOLD_ROWS = 64
#: A text is template where this share of a host's pages has it at one place, of at least `TEMPLATE_PAGES` pages.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.6, 4
#: Without an article region: slots with at least this share of linked text are menus.
LINK_SHARE = 0.5
#: Share of a page's text that its article or main elements hold at least; below it they are teasers.
REGION_SHARE = 0.3

# HTML elements by their part in a page.
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea iframe svg object select option button canvas audio video".split())
_NOT_MAIN = set("head title nav header footer aside form menu dialog fieldset".split())
_CLOSED_BY_BLOCK = {"p"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ARTICLE = {"article", "main"}
# Words in class, id or role that name other parts of a page.
_OTHER_PART = re.compile(r"^(ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|header|masthead|topbar|footer|bottom|comments?|disqus|respond|replies|reply|cookies?|consent|notice\w*|alert|popup|modal|overlay|share|sharing|social|newsletter|subscribe|signup|login|search|related|recommended|widget\w*|pagination|pager|toolbar|hidden|complementary|contentinfo|dialog|form)$")
# Of these, words of layout, which name a page's layout when they are part of a longer word.
_LAYOUT = re.compile(r"^(banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|header|masthead|topbar|footer|bottom|search|widget\w*|toolbar|form)$")
_WRAPPING = {"form", "fieldset"}
# Words that name another part also inside the main region and as a part of a longer word.
_NEVER_MAIN = re.compile(r"^(ads?|advert\w*|adsense|sponsor\w*|promo\w*|comments?|disqus|respond|replies|cookies?|consent|newsletter|subscribe|popup|modal|overlay|breadcrumbs?|pagination|pager)$")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Parts of names that hold a digit are numbers of their element.
_NUMBERED = re.compile(r"[a-z0-9]*[0-9][a-z0-9]*")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _name(tag: str, attributes: str) -> str:
    """A tag with its class and id, and `!` if it hides what it holds."""
    if not attributes:
        return tag
    parts, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "style":
            hidden |= bool(_HIDING.search(value))
        elif key == "hidden" or key == "aria-hidden":
            hidden |= value.lower() not in ("false", "until-found") if key == "hidden" else value.lower() == "true"
        else:
            parts += [_NUMBERED.sub("0", w) for w in value.lower().split()]
    return ".".join([tag, *dict.fromkeys(parts)]) + ("!" if hidden else "")


class Paths:
    """The distinct paths of a page's block tags as a tree: node 0 is the page, parents come before children."""

    def __init__(self):
        self.parent, self.tag, self.words, self.hidden = [0], [""], [()], [False]
        self.keys, self.children = [_ROOT], {}

    def child(self, node: int, name: str) -> int:
        """The node of a tag named `name` (see `_name`) inside `node`."""
        at = (node, name)
        if at not in self.children:
            self.children[at] = len(self.parent)
            tag, *words = name.rstrip("!").split(".")
            self.parent.append(node)
            self.tag.append(tag)
            self.words.append(tuple(words))
            self.hidden.append(name.endswith("!"))
            self.keys.append(hashlib.blake2b(self.keys[node] + name.encode("utf-8", "replace"), digest_size=8).digest())
        return self.children[at]

    def key(self, node: int) -> str:
        """A path's name among all pages of a host."""
        return self.keys[node].hex()

    def up(self, node: int) -> Iterator[int]:
        while node:
            yield node
            node = self.parent[node]


_ROOT = b"\0" * 8


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def blocks_of(page: str | None, paths: Paths) -> Iterator[tuple[int, str | None, int]]:
    """(node, text, linked characters) of each block of text, and (node, None, 0) at each opened block tag."""
    stack: list[int] = [0]
    open_tags: Counter = Counter()
    text: list[str] = []
    linked, in_link, at = 0, False, 0
    page = page or ""
    lower = None

    def flush():
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        n, linked = min(linked, len(joined)), 0
        return (stack[-1], joined, n) if joined else None

    def pop() -> str:
        tag = paths.tag[stack.pop()]
        open_tags[tag] -= 1
        return tag

    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        text.append(piece)
        if in_link:
            linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not tag:
            continue
        if tag in _RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                lower = lower if lower is not None else page.lower()
                end = lower.find(f"</{tag}", at)
                at = at if end < 0 and tag not in ("script", "style") else (len(page) if end < 0 else end)
            continue
        if tag == "a":
            in_link = not closing
        if tag == "br":
            text.append(" ")
        if tag not in _BLOCK:
            continue
        if found := flush():
            yield found
        if closing:
            in_link = False
            if open_tags[tag] > 0:
                while pop() != tag:
                    pass
            continue
        if paths.tag[stack[-1]] in _CLOSED_BY_BLOCK:
            pop()
        if tag in _SIBLINGS and paths.tag[stack[-1]] in _SIBLINGS[tag]:
            if pop() in ("td", "th") and tag == "tr" and paths.tag[stack[-1]] == "tr":
                pop()
        if tag not in _VOID:
            if tag == "body" and open_tags["head"] > 0:
                while pop() != "head":
                    pass
            stack.append(paths.child(stack[-1], _name(tag, attributes)))
            open_tags[tag] += 1
            yield stack[-1], None, 0
    if found := flush():
        yield found


# A wrapper is a list of items: a path's key (an opened tag), a key with `#` (a text slot), a key with `=` and the
# hash of a text (a fixed text), or a group ["?", items] (optional) or ["+", items] (repeated).


def folded(items: list) -> list:
    """The list with runs of equal units of up to 4 items as repeated groups."""
    for width in (1, 2, 3, 4):
        out, i = [], 0
        while i < len(items):
            unit, n = items[i : i + width], 1
            while len(unit) == width and items[i + n * width : i + (n + 1) * width] == unit:
                n += 1
            if n > 1:
                out.append(unit[0] if width == 1 and isinstance(unit[0], list) and unit[0][0] == "+" else ["+", unit])
                i += n * width
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _core(item) -> str:
    """What an item is compared by: a group by what it holds."""
    while isinstance(item, list) and len(item[1]) == 1:
        item = item[1][0]
    return item if isinstance(item, str) else json.dumps([_core(x) for x in item[1]])


def _marks(item) -> set[str]:
    out = set()
    while isinstance(item, list):
        out.add(item[0])
        item = item[1][0] if len(item[1]) == 1 else None
    return out


def aligned(a: list, b: list) -> list:
    """The wrapper that matches what either matches."""
    keys_a, keys_b = [_core(x) for x in a], [_core(x) for x in b]
    out: list = []
    for kind, i0, i1, j0, j1 in SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(a[i0:i1], b[j0:j1]):
                marks = _marks(x) | _marks(y)
                core = x
                while isinstance(core, list) and len(core[1]) == 1:
                    core = core[1][0]
                inner = core[1] if isinstance(core, list) else [core]
                item = ["+", inner] if "+" in marks or (isinstance(core, list) and core[0] == "+") else core
                out.append(["?", [item]] if "?" in marks and not (isinstance(item, list) and item[0] == "?") else item)
            continue
        for side in (a[i0:i1], b[j0:j1]):
            for item in side:
                if out and _core(out[-1]) == _core(item):  # one more of the unit before: a repeated group
                    if "+" not in _marks(out[-1]):
                        out[-1] = ["+", [out[-1]]] if isinstance(out[-1], str) else out[-1]
                else:
                    out.append(item if isinstance(item, list) and item[0] == "?" else ["?", [item]])
    return out


def leaves(wrapper: list) -> Iterator[str]:
    """The wrapper's items without its groups."""
    for item in wrapper:
        if isinstance(item, list):
            yield from leaves(item[1])
        else:
            yield item


def slots(wrapper: list) -> Iterator[str]:
    """Keys of the wrapper's text slots."""
    return (item[:-1] for item in leaves(wrapper) if item.endswith("#"))


def fixed_texts(wrapper: list) -> Iterator[str]:
    """`key=hash` of the wrapper's fixed texts."""
    return (item for item in leaves(wrapper) if "=" in item)


def _other_parts(paths: Paths, wraps: set[int], region: int, named: bool) -> tuple[list[bool], list[bool]]:
    """Per node, whether it is no part of the main text, and whether only part of a name inside the region says so.

    wraps: nodes that hold the page's main region, `region` the innermost. Forms and layout words in longer
    words are neutral on them, and all words without `named`.
    """
    other, doubtful = [False] * len(paths.parent), [False] * len(paths.parent)
    article, inside = [False] * len(paths.parent), [False] * len(paths.parent)
    for k in range(1, len(paths.parent)):
        up, tag, words, around = paths.parent[k], paths.tag[k], paths.words[k], k in wraps
        article[k] = article[up] or tag in _ARTICLE
        inside[k] = inside[up] or up == region
        doubtful[k] = doubtful[up]
        if other[up] or paths.hidden[k] or (tag in _NOT_MAIN and not (tag == "header" and article[up]) and not (around and tag in _WRAPPING)):
            other[k] = True
            continue
        if tag in ("html", "body") or (around and not named):
            continue
        parts = [part for w in words for part in _SPLIT.split(w)]
        if any(_OTHER_PART.match(w) for w in words) or any(_NEVER_MAIN.match(part) for part in parts):
            other[k] = True
        elif any(_OTHER_PART.match(part) and not (around and _LAYOUT.match(part)) for part in parts):
            if inside[k]:
                doubtful[k] = True
            else:
                other[k] = True
    return other, doubtful


_SPLIT = re.compile(r"[-_:]+")


def main_blocks(page: str | None, menus: set[str], fixed: set[str] = frozenset()) -> list[str]:
    """Texts of the page's main blocks. `menus`: keys of the host's slots of mostly linked text, `fixed`: its fixed
    texts, as `key=hash`.
    """
    paths = Paths()
    opened: dict[int, int] = {}
    blocks: list[tuple[int, str, int, tuple | None]] = []
    outermost: list[int] = [0]  # per node, the outermost article or main element on its path
    for node, text, linked in blocks_of(page, paths):
        for k in range(len(outermost), len(paths.parent)):
            outermost.append(outermost[paths.parent[k]] or (k if paths.tag[k] in _ARTICLE else 0))
        if text is None:
            opened[node] = opened.get(node, 0) + 1
            continue
        # Told from others with the same path by how often that had opened.
        blocks.append((node, text, linked, (outermost[node], opened[outermost[node]]) if outermost[node] else None))
    never = [False] * len(paths.parent)
    for k in range(1, len(never)):
        never[k] = never[paths.parent[k]] or paths.hidden[k] or paths.tag[k] in _NOT_MAIN - _WRAPPING - {"header"}
    sizes, regions = [0] * len(paths.parent), Counter()
    for node, text, linked, region in blocks:
        if not never[node]:
            sizes[node] += len(text) - linked
            if region:
                regions[region] += len(text) - linked
    for k in range(len(sizes) - 1, 0, -1):
        sizes[paths.parent[k]] += sizes[k]
    if regions and regions.total() >= REGION_SHARE * sizes[0]:
        region = max(regions, key=regions.get)[0]
        wraps = set(paths.up(region))
    else:
        wraps = {k for k in range(1, len(sizes)) if 2 * sizes[k] > sizes[0]}
        region = max((k for k in wraps if paths.tag[k] not in ("html", "body")), default=-1)
    is_fixed = [f"{paths.key(node)}={text_hash(text):x}" in fixed for node, text, *_ in blocks] if fixed else [False] * len(blocks)
    for named in (True, False):
        other, doubtful = _other_parts(paths, wraps, region, named)
        kept = []
        for block, template in zip(blocks, is_fixed):
            node = block[0]
            if other[node] or (doubtful[node] and (template or paths.key(node) in menus)):
                continue
            kept.append((block, template))
        total = sum(len(b[1]) - b[2] for b, _ in kept)
        for tag in ("article", "main"):
            within = [False] * len(paths.parent)
            for k in range(1, len(within)):
                within[k] = within[paths.parent[k]] or paths.tag[k] == tag
            inside = [(b, t) for b, t in kept if within[b[0]]]
            if inside and sum(len(b[1]) - b[2] for b, _ in inside) >= REGION_SHARE * total:
                return _without_template(inside)
        if found := [(b, t) for b, t in kept if paths.key(b[0]) not in menus]:
            return _without_template(found)
    return []


def _without_template(blocks: list[tuple[tuple, bool]]) -> list[str]:
    """Texts that are not template; all, where template is most of the text: copies of one page fill the host."""
    fixed = sum(len(b[1]) for b, template in blocks if template)
    keep_all = 2 * fixed > sum(len(b[1]) for b, _ in blocks)
    return [b[1] for b, template in blocks if keep_all or not template]


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


_ARROW = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}


def _template(rows: DataFrame) -> DataFrame:
    """(host, fixed): the texts, as `key=hash`, that most pages of a host have at one place."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                found: Counter = Counter()
                for host, page in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist()):
                    paths = Paths()
                    texts = {(int.from_bytes(paths.keys[node], "little", signed=True), text_hash(text)) for node, text, _ in blocks_of(page, paths) if text}
                    found.update((host, *t) for t in texts)
                    found[host, 0, 0] += 1
                keys = list(found)
                yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2)), pa.array(list(found.values()), pa.int64())], names=["host", "place", "text", "pages"])

    counts = rows.mapInArrow(count, "host string, place long, text long, pages long").groupBy("host", "place", "text").agg(F.sum("pages").alias("pages"))
    counts = stored(counts.filter(F.col("pages") >= TEMPLATE_PAGES), "page-texts")
    of_host = counts.filter("place = 0 and text = 0").select("host", F.col("pages").alias("all_pages"))
    often = counts.filter("place <> 0").join(of_host, "host").filter(F.col("pages") >= TEMPLATE_SHARE * F.col("all_pages"))
    return often.groupBy("host").agg(F.collect_list(F.struct("place", "text")).alias("fixed"))


def _fixed_names(fixed: list[dict] | None) -> set[str]:
    return {f"{f['place'].to_bytes(8, 'little', signed=True).hex()}={f['text']:x}" for f in fixed or ()}


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, menus, fixed): each host's wrapper as JSON, the keys of its slots of mostly linked text, and its
    fixed texts.
    """

    def outline(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                found: dict[tuple[str, str], dict[str, list[int]]] = {}
                known: dict[str, set[str]] = {}
                for host, page, fixed in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist(), piece.column("fixed").to_pylist()):
                    if host not in known:
                        known[host] = _fixed_names(fixed)
                    items = []
                    sums: dict[str, list[int]] = {}
                    paths = Paths()
                    for node, text, linked in blocks_of(page, paths):
                        key = paths.key(node)
                        if text is None:
                            items.append(key)
                            continue
                        name = f"{key}={text_hash(text):x}"
                        items.append(name if name in known[host] else f"{key}#")
                        s = sums.setdefault(key, [0, 0])
                        s[0] += len(text)
                        s[1] += linked
                    total = found.setdefault((host, json.dumps(folded(items))), {})
                    for p, (n, k) in sums.items():
                        t = total.setdefault(p, [0, 0])
                        t[0] += n
                        t[1] += k
                rows = [(h, s, p, n, k) for (h, s), total in found.items() for p, (n, k) in (total or {"": [0, 0]}).items()]
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["host", "skeleton", "path", "chars", "linked"])

    rows = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    template = stored(_template(rows).withColumnRenamed("host", "of"), "template")
    rows = rows.join(template, F.col("host") == F.col("of"), "left").drop("of")
    outlines = rows.mapInArrow(outline, "host string, skeleton string, path string, chars long, linked long")
    outlines = stored(outlines.groupBy("host", "skeleton", "path").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")), "outlines")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = part = wrapper = last = None

        def out():
            return pa.record_batch([pa.array([host]), pa.array([json.dumps(wrapper)])], names=["host", "wrapper"])

        for batch in batches:
            for h, p, s in zip(batch.column("host").to_pylist(), batch.column("part").to_pylist(), batch.column("skeleton").to_pylist()):
                if (h, p) != (host, part):
                    if wrapper is not None:
                        yield out()
                    host, part, wrapper, last = h, p, json.loads(s), s
                elif s != last:
                    wrapper, last = aligned(wrapper, json.loads(s)), s
        if wrapper is not None:
            yield out()

    def folded_by(df: DataFrame) -> DataFrame:
        return df.repartition("host", "part").sortWithinPartitions("host", "part", "skeleton").mapInArrow(fold, "host string, wrapper string")

    def in_parts(df: DataFrame, most: int) -> DataFrame:
        # By its text's hash: a host's parts are no more than its skeletons.
        return df.withColumn("part", F.pmod(F.xxhash64("skeleton"), F.lit(math.ceil(most / FOLD_ROWS))))

    level = outlines.select("host", "skeleton").distinct()
    most = level.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > FOLD_ROWS:
        parts = math.ceil(most / FOLD_ROWS)
        level = stored(folded_by(in_parts(level, most)).select("host", F.col("wrapper").alias("skeleton")), "wrapper-parts")
        most = min(most, parts)
    whole = folded_by(level.withColumn("part", F.lit(0).cast("long")))
    sums = outlines.groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    by_host = sums.groupBy("host").agg(F.collect_list(F.struct("path", "chars", "linked")).alias("sums"))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            menus, fixed = [], []
            for w, sums in zip(batch.column("wrapper").to_pylist(), batch.column("sums").to_pylist()):
                wrapper = json.loads(w)
                chars = {s["path"]: (s["chars"], s["linked"]) for s in sums}
                menus.append([p for p in dict.fromkeys(slots(wrapper)) if chars.get(p, (0, 0))[1] >= LINK_SHARE * max(1, chars.get(p, (0, 0))[0])])
                fixed.append(list(dict.fromkeys(fixed_texts(wrapper))))
            lists = (pa.array(x, pa.list_(pa.string())) for x in (menus, fixed))
            yield pa.record_batch([batch.column("host"), batch.column("wrapper"), *lists], names=["host", "wrapper", "menus", "fixed"])

    return stored(whole.join(by_host, "host").select("host", "wrapper", "sums").mapInArrow(label, "host string, wrapper string, menus array<string>, fixed array<string>"), "wrappers")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Blocks are joined by a blank line; white space in a block is one space. A null or empty page, or one
    without main text, has an empty text. Pages without a host share one wrapper. Repeated rows have a
    result each; an empty table gives no rows. Other columns are not read.
    """
    known = wrappers(pages, url_col, html_col).select(F.col("host").alias("of"), "menus", "fixed")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), _host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = []
                for page, menus, fixed in zip(*(piece.column(c).to_pylist() for c in ("html", "menus", "fixed"))):
                    texts.append("\n\n".join(main_blocks(page, set(menus or ()), set(fixed or ()))))
                yield pa.record_batch([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=list(_ARROW))

    joined = rows.join(known, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "menus", "fixed")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
