"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

A page is parsed into a tree of labelled elements and text slots. Same-host pages are aligned one
after another: children that both have are merged (a longest common subsequence of their labels), a
child that only one has becomes optional, and runs of equal siblings become a repeated group; texts
that differ become slots, texts that never do stay as the template's. What results is a wrapper: an
expression over tags, slots, `?` and `+` without alternatives. Wrappers align with one another just
as pages do: groups of about FAN pages of a host are folded in order of their content, then FAN of
what results, until one is left, so a wrapper doesn't depend on how pages were partitioned.

A slot of the wrapper is content or template. It is template where every page (without text apart) of
at least CONSTANT_PAGES of the host has the same text there, outside of articles; where texts stand in
links alone on every page, in a list or a box outside of articles; and inside menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments, told by tag, or by a class, id or role
made of template words alone. In pages with an article or main element only that counts. Pages are
matched against the wrapper of their host; content slots give the text. Where nothing on a host's
pages varies, nothing counts as constant.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by a line break in page order.

Edge cases: null or empty html gives the empty text; a null url has the empty host, whose pages
share a wrapper; an element that the wrapper lacks, or that lies over WRAPPER_DEPTH elements deep, is
judged by its own labels; hosts of fewer than CONSTANT_PAGES pages have no constants; broken markup,
missing end tags and stray `<` are read as browsers do, roughly; repeated rows are extracted one by
one; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.common import discard, materialise

WRAPPER_DEPTH = 100
CONSTANT_PAGES = 5
FAN = 256
TABLE_CELLS = 1 << 22
BROADCAST_BYTES = 32_000_000

TOKEN = re.compile(r"""<!--.*?(?:--!?>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|$)|[^<]+|<""", re.S)
LABELS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LISTS, BOXES = frozenset({"ul", "ol"}), frozenset("div section table dl".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# What marks an element as no part of the article. A class, id or role does so as a whole: all its
# parts are template words, but for NEUTRAL ones beside them. NEVER is told by its tag alone.
TEMPLATE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe button select textarea svg menu dialog canvas object title".split())
TEMPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments reply replies respond disqus discussion widget toolbar pagination pager skip copyright complementary contentinfo".split()
)

NEUTRAL = frozenset("site global box bar container wrapper wrap list area unit slot links buttons block inner".split())
NEVER = frozenset("html body main article".split())


class Element:
    __slots__ = ("tag", "label", "children")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.children = tag, label, []


def _label(tag: str, attributes: str) -> str:
    """The tag with its class, id and role words, each whole, its parts joined by hyphens; digits don't count."""
    words = {w for _, a, b, c in LABELS.findall(attributes) for t in (a or b or c).lower().split() if (w := re.sub(r"[^a-z]+", "-", t).strip("-"))} if attributes else ()
    return ".".join([tag, *sorted(words)])


def parse(page: str) -> Element:
    """The tree of a page; texts are str, whatever else is an Element."""
    root = Element("", "")
    stack, at, n = [("", root)], 0, len(page)
    places: dict[str, list[int]] = {}

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(k: int) -> None:
        """Close all from place k on."""
        if k:
            for tag, _ in stack[k:]:
                places[tag].pop()
            del stack[k:]

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                stack[-1][1].children.append(m[0])
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            cut(last((tag,)))
            continue
        if tag in BLOCK:  # an open paragraph ends where a block begins; so no block is ever open inside of one
            cut(last(("p",)))
        if tag in CLOSES and (k := last(CLOSES[tag])) > last(HOLDS[tag]):
            cut(k)
        attributes = m[3] if m[2] else m[6]
        element = Element(tag, _label(tag, attributes))
        stack[-1][1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            element.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, element))
    return root


# A wrapper's item is [label, least, most, content]: least 0 is optional, most 2 is repeated. The
# content of a text ("#") is [hash, pages that are known to hold it], or None for a slot, where
# texts differ; of an element, its list of items.


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode(errors="replace"), digest_size=6).hexdigest()


def _items(element: Element, depth: int = 0) -> list:
    found = []
    for child in element.children:
        if isinstance(child, str):
            text = " ".join(child.split())
            if text:
                found.append(["#", 1, 1, [_hash(text), 1]])
        elif child.tag in RAW or depth == WRAPPER_DEPTH:
            found.append([child.label, 1, 1, []])
        else:
            found.append([child.label, 1, 1, _items(child, depth + 1)])
    return _fold(found)


def _merge(a: list, b: list, pages=max) -> list:
    """Two occurrences of the same item as one; pages of a text are at least the greater number where
    both occur in the same pages, and the sum where they occur in different ones."""
    if a[0] != "#":
        content = align(a[3], b[3], pages)
    else:
        content = [a[3][0], pages(a[3][1], b[3][1])] if a[3] and b[3] and a[3][0] == b[3][0] else None
    return [a[0], min(a[1], b[1]), max(a[2], b[2]), content]


def _fold(items: list) -> list:
    """Runs of one label, or of two that take turns, become repeated items."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            merged = _merge(out[-1], item)
            out[-1] = [merged[0], max(out[-1][1], item[1]), 2, merged[3]]
        elif len(out) >= 3 and out[-2][0] == item[0] and out[-1][0] == out[-3][0]:
            # a b a + b: the second pair folds into the first
            first, second = _merge(out[-3], out[-1]), _merge(out[-2], item)
            out[-3:] = [[first[0], out[-3][1], 2, first[3]], [second[0], second[1], 2, second[3]]]
        else:
            out.append(item)
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of a and each start of b."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence: by a table, or for long ones by halves, in bounded memory."""
    codes: dict = {}
    x, y = (np.array([codes.setdefault(v, len(codes)) for v in side], dtype=np.int32) for side in (a, b))
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > TABLE_CELLS:
            half = (a0 + a1) // 2
            split = b0 + int((_lengths(x[a0:half], y[b0:b1]) + _lengths(x[half:a1][::-1], y[b0:b1][::-1])[::-1]).argmax())
            todo += [(a0, half, b0, split), (half, a1, split, b1)] if a1 - a0 > 1 else [(a0, a1, b0 + k, b0 + k + 1) for k in np.flatnonzero(y[b0:b1] == x[a0])[:1]]
            continue
        rest = np.zeros((a1 - a0 + 1, b1 - b0 + 1), dtype=np.int32)  # of what is left from each place on
        for i in range(a1 - a0 - 1, -1, -1):
            best = np.maximum(rest[i + 1, :-1], rest[i + 1, 1:] + (y[b0:b1] == x[a0 + i]))
            rest[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
        i = j = 0
        while rest[i, j]:
            if x[a0 + i] == y[b0 + j]:
                found.append((a0 + i, b0 + j))
                i, j = i + 1, j + 1
            elif rest[i + 1, j] == rest[i, j]:
                i += 1
            else:
                j += 1
    return sorted(found)


def align(a: list, b: list, pages=add) -> list:
    """The expression that covers both sequences of items: a longest common subsequence of labels
    is merged, the rest becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_merge(x, y, pages) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for p, q in [*common([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [[x[0], 0, *x[2:]] for x in (*a[i:p], *b[j:q])]
        out += [_merge(a[p], b[q], pages)] if p < len(a) else []
        i, j = p + 1, q + 1
    return _fold(out)


def merge_wrappers(a: list | None, b: list) -> list:
    """Wrappers are [pages that have items, items]."""
    return b if a is None else [a[0] + b[0], align(a[1], b[1])]


@lru_cache(maxsize=65536)
def _is_template(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in TEMPLATE_TAGS or tag not in NEVER and _template_words(words)


def _template_words(words: list[str]) -> bool:
    """Whether one of the words is made of template words alone, NEUTRAL ones beside them."""
    kept = [[w for w in word.split("-") if w not in NEUTRAL] for word in words]
    return any(parts and TEMPLATE_WORDS.issuperset(parts) for parts in kept)


@lru_cache(maxsize=65536)
def _is_main(label: str) -> bool:
    tag, *words = label.split(".")
    parts = {w for word in words for w in word.split("-")}
    return tag in ("article", "main") or "main" in parts and tag in ("div", "section") and "content" in parts


def _links_alone(items: list) -> bool:
    """Whether every text of the items stands in a link."""
    return all(x[0] != "#" and (x[0].split(".")[0] == "a" or _links_alone(x[3])) for x in items)


def _links(items: list) -> int:
    """Links among the items; a repeated one counts as two."""
    return sum(x[2] * (1 if x[0].split(".")[0] == "a" else min(2, _links(x[3]))) for x in items if x[0] != "#" and x[3])


def _kind(label: str) -> str:
    """What the labels of an element say of it."""
    return "template" if _is_template(label) else "main" if _is_main(label) else ""


@lru_cache(maxsize=4096)
def judged(wrapper: str) -> dict:
    """The wrapper as {label: (kind, inner)}: kind of the element, and what is inside of it; under "#" the hashes of
    constant texts with how often each stands there."""
    pages, items = json.loads(wrapper)

    def varies(items: list) -> bool:
        return any((not x[3] or x[3][1] != pages) if x[0] == "#" else not _is_template(x[0]) and varies(x[3]) for x in items)

    constants = pages >= CONSTANT_PAGES and varies(items)

    def join(a: dict, b: dict) -> dict:
        """a with what b has: items of one label are judged together, at every depth."""
        for label, x in b.items():
            if label == "#":
                a["#"] = (held := a.get("#", {})) | {h: held.get(h, 0) + n for h, n in x.items()}
            elif label in a:
                a[label] = (x[0] if x[0] == a[label][0] else _kind(label), join(a[label][1], x[1]))
            else:
                a[label] = x
        return a

    def walk(items: list, again: bool = False, in_main: bool = False) -> dict:
        out: dict = {}
        for label, least, most, content in items:
            if label == "#":
                if constants and not in_main and content and least and content[1] == pages:
                    join(out, {"#": {content[0]: math.inf if again or most > 1 else 1}})
                continue
            kind = _kind(label)
            if not kind and content and label.split(".")[0] in LISTS | BOXES and _links_alone(content) and (label.split(".")[0] in LISTS or _links(content) > 1):
                kind = "links"
            join(out, {label: (kind, walk(content, again or most > 1, in_main or kind == "main"))})
        return out

    return walk(items)


def extract(page: str | None, wrapper: str | None) -> str:
    """The main text of a page by the wrapper of its host."""
    if not page:
        return ""
    root = parse(page)

    def kind_of(element: Element, slots: dict | None) -> tuple[str, dict | None]:
        known = slots.get(element.label) if slots else None
        return known or (_kind(element.label), None)

    slots = judged(wrapper) if wrapper else None
    regions: list[tuple[Element, dict | None]] = []
    todo = [(c, slots) for c in reversed(root.children) if not isinstance(c, str)]
    while todo:
        element, around = todo.pop()
        kind, inner = kind_of(element, around)
        if kind == "main":
            regions.append((element, inner))
        elif kind != "template":
            todo += [(c, inner) for c in reversed(element.children) if not isinstance(c, str)]
    blocks: list[str] = []
    buffer: list[str] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            blocks.append(text)

    met: dict = {}

    def constant(text: str, slots: dict | None) -> bool:
        """Whether the text is one that all pages have here, and not a further copy of it."""
        if not slots or "#" not in slots or not (text := " ".join(text.split())):
            return False
        place = id(slots), _hash(text)
        met[place] = met.get(place, 0) + 1
        return met[place] <= slots["#"].get(place[1], 0)

    def hidden(child: Element, kind: str, in_main: bool) -> bool:
        # An article's own header holds its headline.
        headline = in_main and child.tag == "header" and not _template_words(child.label.split(".")[1:])
        return child.tag in RAW or kind == "template" and not headline or kind == "links" and not in_main

    for region, inner in regions or [(root, slots)]:
        todo = [(c, inner) for c in reversed(region.children)]
        while todo:
            child, around = todo.pop()
            if child is None:
                close()
            elif isinstance(child, str):
                if not constant(child, around):
                    buffer.append(child)
            elif child.tag == "br":
                buffer.append(" ")
            else:
                kind, within = kind_of(child, around)
                if not hidden(child, kind, bool(regions)):
                    if child.tag in BLOCK:
                        close()
                        todo.append((None, None))
                    todo += [(c, within) for c in reversed(child.children)]
        close()
    return "\n".join(blocks)


def host_of(url: str) -> "F.Column":
    return F.expr(rf"translate(regexp_extract(coalesce({url}, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def infer(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """host and wrapper (JSON) of every host, from all of its pages.

    Pages of a host are dealt to parts by a hash of their structure, and each part is folded in the order of it: in
    rounds of about FAN to a part, whatever the host's share of all pages, and without holding a part's pages.
    """

    def single(batches):
        for batch in batches:
            made = []
            for page in batch.column("body"):
                items = _items(parse(page.as_py() or ""))
                made.append(json.dumps([1 if items else 0, items], separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], ["host", "wrapper"])

    def fold(batches):
        at, whole = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([json.dumps(whole, separators=(",", ":"))], pa.string())], ["host", "wrapper"])

        for batch in batches:
            for host, part, wrapper in zip(batch.column("host").to_pylist(), batch.column("part").to_pylist(), batch.column("wrapper")):
                if at != (host, part):
                    if at is not None:
                        yield out()
                    at, whole = (host, part), None
                whole = merge_wrappers(whole, json.loads(wrapper.as_py()))
        if at is not None:
            yield out()

    schema = "host string, wrapper string"
    rows = materialise(pages.select(host_of(url).alias("host"), F.col(body).alias("body")).mapInArrow(single, schema), "wrapper-pages")
    left, first = rows.count(), rows
    while True:
        left = -(-left // FAN)
        dealt = rows.withColumn("part", F.expr(f"pmod(xxhash64(wrapper), {left}L)")).repartition("host", "part").sortWithinPartitions("host", "part", "wrapper")
        rows = dealt.mapInArrow(fold, schema)
        if left <= 1:
            rows = materialise(rows, "wrappers")
            discard(first)
            return rows


def main_text(pages: DataFrame, url: str = "url", body: str = "html", text: str = "text") -> DataFrame:
    """pages, without the html, with the main text of each. Wrappers of BROADCAST_BYTES at most are broadcast, others joined."""
    wrappers = infer(pages, url, body)
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    keep = [c for c in pages.columns if c not in (body, text)]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(text, T.StringType())])
    rows = pages.select(F.struct(*keep).alias("_row"), F.col(body).alias("_body"), host_of(url).alias("_host"))
    known = None
    if size <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})
    else:
        rows = rows.join(wrappers.withColumnRenamed("host", "_host"), "_host", "left").select("_row", "_body", F.col("wrapper").alias("_host"))

    def run(batches):
        for batch in batches:
            told = batch.column("_host").to_pylist()
            told = [known.value.get(h) for h in told] if known else told
            made = pa.array([extract(page.as_py(), wrapper) for page, wrapper in zip(batch.column("_body"), told)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.column("_row").flatten(), made], schema.names)

    return rows.mapInArrow(run, schema)


def op6_html_wrappers(spark, sf_dir: str) -> DataFrame:
    from convlake.llm.common import table

    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
