"""Main text of web pages, by templates deduced from equivalence classes of tokens.

A page's tokens are the elements around its slots (by path of tags with class words) and the slots' text blocks (by path and text). Pages of a host
with equal slots count once and pages without any don't count, so copies and empty pages change no template; pages with and without article or
main are kept apart. For each host and token an occurrence fingerprint is made: the exclusive or, over the pages, of a hash of page and number of
occurrences. Tokens with equal fingerprints occur equally often in every page and form an equivalence class. Fingerprints add up in any order, so
a host is never in one task.

Classes nest: a token hangs below its nearest ancestor of the same class, and the topmost element of a class below the class of its parent, up to the
root, which is once in every page. Tokens without such an ancestor are no part of a template. Tokens of one class below one element make a group; a
group is valid if they come in the same order, over and over, in every page. Text in valid groups is part of the template, not of a page.
In an article only the root's class counts, as other classes there may be passages that some articles share. Shared text must be the lesser part of
its surroundings, else the pages are versions of one text and keep it: in an article less than half of the host's article text, elsewhere less than
half of the text at its path, or all of it, as in a notice's own element.

Slots that remain are chosen by the host's pages together. Where they mark no article, the template's tree is followed from the root into the one
element below which at least DOMINANT of all text lies that differs from page to page and is no link, as long as there is one with elements of
its own: what is outside of it, but for main headings, is menu, notice, footer or comment, whatever it is called. Slots that are mostly links
on the host's pages go too. Where pages mark an article, its slots are those inside. What a tag or a class word says to be something
other than the article (form, aside, comments and the like) goes on every page, which is all that there is to go by on hosts with few pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .url_filter import host_and_path

#: Different pages that a host and a class must have before text is taken for its template.
LEAST_PAGES = 8
#: Share of a host's pages in which a token must be to count, and share of its text in links from which it is a list of links.
SUPPORT, LINKS = 0.1, 0.5
#: Share of a host's own text below an element from which that element is the article's.
DOMINANT = 0.7
HELD = 200_000
BROADCAST = 8 << 20
ROOT = 0

#: Names of HTML elements.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body head main article section nav aside header footer div p ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 form fieldset legend blockquote pre figure figcaption address details summary dialog hgroup search select option button svg object canvas audio video menu".split()
)
CLOSES_P = BLOCKS - frozenset("html body head li dt dd tr td th thead tbody tfoot caption option legend figcaption summary button select".split())
NOT_TEXT = frozenset("head nav footer aside form fieldset dialog search select option button svg object canvas audio video menu".split())
#: Words in class, id or role that name something other than the article.
NOT_ARTICLE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary footer contentinfo ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert alerts notification popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget widgets toolbar pagination pager topbar masthead form".split()
)
NOT_FORM = NOT_ARTICLE - {"form"}
HEADER = frozenset(["header", "masthead"])
#: Words that turn a class into a statement about the page, as in no-sidebar, and words that say nothing beside others.
STATES = frozenset("no not non without with has have is show hide hidden toggle".split())
PLAIN = frozenset(
    "site page main article post posts entry story content body text top bottom left right center box bar list item items section sections container wrapper wrap block area inner outer panel link links icon icons button buttons group row col column grid primary secondary global local user users reader readers inline sticky floating fixed small large".split()
)

FORM, OTHER = 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^<>]*(?:>|\Z)|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    """A run of text: its path's hash, its text, characters of it in links, whether the path names the article or something else, its place, and whether it is a main heading."""

    __slots__ = ("path", "text", "links", "main", "other", "at", "heading")

    def __init__(self, path: int, text: str, links: int, main: bool, other: bool, at: int, heading: bool):
        self.path, self.text, self.links, self.main, self.other, self.at, self.heading = path, text, links, main, other, at, heading


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _named(tag: str, attributes: str) -> tuple[str, frozenset, frozenset]:
    """Of a tag: its class, id and role words as text; those that name a part of a page; and those of them that do so inside an article.

    A name that begins with a state names nothing. Inside an article all words of a name must be of a part or plain: search-box, not search-algorithms.
    """
    if not attributes or "=" not in attributes:
        return "", frozenset(), frozenset()
    words: list[str] = []
    parts: set[str] = set()
    strict: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for name in (m[2] or m[3] or m[4] or "").split():
                own = [w.lower() for w in _WORD.findall(name)]
                words += own
                if own and own[0] not in STATES:
                    parts.update(own)
                    if all(w in NOT_ARTICLE or w in PLAIN or len(w) == 1 for w in own):
                        strict.update(own)
    return " ".join(words), frozenset(parts), frozenset(strict)


def parse(html: str | None) -> tuple[list[Block], dict[int, tuple[int, list]]]:
    """The text blocks in order, and for every element path its [parent path, places]. Places count blocks and elements from 1."""
    html = html or ""
    blocks: list[Block] = []
    paths: dict[int, tuple[int, list]] = {}
    # open elements: (tag, path, in the article, something else: 0, FORM or OTHER)
    stack: list[tuple] = [("", ROOT, False, 0)]
    buffer: list[str] = []
    links = in_link = place = 0

    def flush() -> None:
        nonlocal links, place
        text = " ".join(unescape("".join(buffer)).split())
        if text:
            tag, path, main, other = stack[-1]
            place += 1
            blocks.append(Block(path, text, min(links, len(text)), main, bool(other), place, tag == "h1"))
        buffer.clear()
        links = 0

    def text(part: str) -> None:
        nonlocal links
        if part:
            buffer.append(part)
            if in_link:
                links += len(part)

    at, lower = 0, None
    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS or tag == "br":
                flush()
                if any(x[0] == tag for x in stack):
                    while stack.pop()[0] != tag:
                        pass
            continue
        if tag in RAW:
            lower = lower or html.lower()
            end = lower.find(f"</{tag}", at)
            close = html.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(html)
            continue
        if tag == "a":
            in_link = 1
        if tag in ("br", "hr"):
            flush()
        if tag not in BLOCKS:
            continue
        flush()
        if tag in CLOSES_P and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "option", "tr") and stack[-1][0] == tag:
            stack.pop()
        _, parent, main, other = stack[-1]
        shown, words, inside = _named(tag, m[3])
        path = _hash(parent, tag, shown)
        place += 1
        paths.setdefault(path, (parent, []))[1].append(place)
        if tag in ("article", "main"):
            # a form around a whole article is the page's, not a form to fill in
            other = OTHER if other == OTHER or words & {"comment", "comments", "reply"} else 0
            main = True
        elif tag not in ("html", "body"):
            if tag != "form" and tag in NOT_TEXT or (inside if main else words) & (NOT_FORM if tag == "form" else NOT_ARTICLE) or not main and (tag == "header" or words & HEADER):
                other = OTHER
            elif tag == "form":
                other = other or FORM
        if tag not in VOID:
            stack.append((tag, path, main, other))
    text(html[at:])
    flush()
    return blocks, paths


def text_token(block: Block) -> int:
    return _hash("text", block.path, block.text)


def slots(blocks: list[Block]) -> list[Block]:
    """Blocks whose path names nothing other than the article; those in the article if any is."""
    own = [b for b in blocks if not b.other]
    return [b for b in own if b.main] or own


_CONTENTS_DDL = "host string, article boolean, content long, items array<struct<token: long, parent: long, is_text: boolean, chars: long, links: long, at: array<int>>>"
_ITEM = pa.struct([("token", pa.int64()), ("parent", pa.int64()), ("is_text", pa.bool_()), ("chars", pa.int64()), ("links", pa.int64()), ("at", pa.list_(pa.int32()))])
_CONTENTS = pa.schema([("host", pa.string()), ("article", pa.bool_()), ("content", pa.int64()), ("items", pa.list_(_ITEM))])


def page_items(html: str | None) -> tuple[bool, int, list[tuple]] | None:
    """Whether the page marks an article, a hash of its slots, and its tokens in order of their hash; none without slots."""
    blocks, paths = parse(html)
    own = slots(blocks)
    if not own:
        return None
    # token: [parent, is text, chars, links, places]; the root has the sums of all
    items: dict[int, list] = {ROOT: [ROOT, False, 0, 0, [0]]}
    texts = [text_token(b) for b in own]
    for b, token in zip(own, texts, strict=True):
        path = b.path
        while path not in items:
            parent, at = paths[path]
            items[path] = [parent, False, 0, 0, at]
            path = parent
        text = items.setdefault(token, [b.path, True, 0, 0, []])
        text[4].append(b.at)
        for x in [text, items[ROOT], *([items[b.path]] if b.path != ROOT else [])]:
            x[2] += len(b.text)
            x[3] += b.links
    return own[0].main, _hash(*texts), sorted((token, *x) for token, x in items.items())


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each page with slots; copies that one task meets are left out."""
    seen: dict[tuple, list] = {}
    names = [f.name for f in _ITEM]
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part, rows = batch.slice(start, 512), []
            for host, html in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if (page := page_items(html.as_py())) is None:
                    continue
                article, content, items = page
                if seen.get((host, article, content)) == (mark := hash(str(items))):
                    continue
                if len(seen) >= HELD:
                    seen.clear()
                seen[host, article, content] = mark
                rows.append({"host": host, "article": article, "content": content, "items": [dict(zip(names, x, strict=True)) for x in items]})
            yield pa.RecordBatch.from_pylist(rows, schema=_CONTENTS)


_MEMBERS_DDL = "host string, article boolean, token long, parent long, is_text boolean, anchor long, chars long, path_chars long, all_chars long, main long"
_MEMBERS = pa.schema([("host", pa.string()), ("article", pa.bool_()), ("token", pa.int64()), ("parent", pa.int64()), ("is_text", pa.bool_()), ("anchor", pa.int64()), ("chars", pa.int64()), ("path_chars", pa.int64()), ("all_chars", pa.int64()), ("main", pa.int64())])


def nest(tokens: list[dict], article: bool) -> list[tuple]:
    """(token, parent, is_text, anchor, chars, chars of the parent's path, chars of all) of the tokens that hang below an element of their class, the anchor."""
    elements = {t["token"]: t for t in tokens if not t["is_text"]}
    kind = {x: (t["print"], t["pages"]) for x, t in elements.items()}
    found = []
    for t in tokens:
        own = (t["print"], t["pages"])
        if t["token"] == ROOT or own[1] < LEAST_PAGES or article and own != kind[ROOT]:
            continue
        anchor = t["parent"]
        while kind.get(anchor) != own and anchor in elements and anchor != ROOT:
            anchor = elements[anchor]["parent"]
        if kind.get(anchor) == own:
            found.append((t["token"], t["parent"], t["is_text"], anchor, t["chars"], elements[t["parent"]]["chars"], elements[ROOT]["chars"]))
    return found


def main_element(tokens: list[dict]) -> int | None:
    """The path below which at least DOMINANT of the text lies that is neither linked nor on half of the pages; none if that is the root."""
    elements = {t["token"]: t for t in tokens if not t["is_text"]}
    weight = {x: max(0, t["chars"] - t["links"]) for x, t in elements.items() if x != ROOT}
    for t in tokens:
        if t["is_text"] and 2 * t["pages"] >= elements[ROOT]["pages"] and t["parent"] in weight:
            weight[t["parent"]] -= max(0, t["chars"] - t["links"])
    below: dict[int, int] = {}
    for x, w in weight.items():
        while x != ROOT and x in elements:
            below[x] = below.get(x, 0) + max(0, w)
            x = elements[x]["parent"]
    total = sum(max(0, w) for w in weight.values())
    containers: dict[int, list] = {}
    parents = {t["parent"] for x, t in elements.items() if x != ROOT}
    for x in parents & below.keys():
        containers.setdefault(elements[x]["parent"], []).append(x)
    at = ROOT
    while (inside := max(containers.get(at, []), key=lambda x: (below[x], x), default=None)) is not None and below[inside] >= DOMINANT * total > 0:
        at = inside
    return None if at == ROOT else at


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of the template's classes; on hosts that mark no article also a row with the main element."""
    for batch in batches:
        for host, article, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = [(host, article, *x, None) for x in nest(tokens, article)]
            if not article and (main := main_element(tokens)) is not None:
                found.append((host, article, None, None, False, None, None, None, None, main))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _MEMBERS, strict=True)], schema=_MEMBERS)


def deduce(pages: DataFrame) -> DataFrame:
    """A row for each host: host, template_text (text tokens of its template), link_lists (paths that are lists of links) and main_path (the main element of pages that mark no article); stored.

    pages: host and html.
    """
    each = pages.select("host", "html").mapInArrow(_contents, _CONTENTS_DDL).groupBy("host", "article", "content")
    each = stored(each.agg(F.min("items").alias("items")), "contents")
    items = each.select("host", "article", "content", F.explode("items").alias("_i")).select("host", "article", "content", "_i.*")
    sums = items.groupBy("host", "article", "token", "is_text").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("content", F.size("at"))).alias("print"), F.min("parent").alias("parent"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    sums = stored(sums.filter("pages > 1"), "tokens")
    roots = sums.filter("token = 0").select(F.col("host").alias("_host"), F.col("article").alias("_article"), F.col("pages").alias("_pages"))
    frequent = sums.join(roots, (F.col("host") == F.col("_host")) & (F.col("article") == F.col("_article"))).filter(F.col("pages") >= SUPPORT * F.col("_pages"))
    # at most 1 / SUPPORT times the tokens of a page for each host
    listed = frequent.filter(F.col("_pages") >= LEAST_PAGES).groupBy("host", "article").agg(F.collect_list(F.struct("token", "parent", "is_text", "pages", "print", "chars", "links")).alias("tokens"))
    found = stored(listed.mapInArrow(_members, _MEMBERS_DDL), "members")
    members, mains = found.filter("main IS NULL").drop("main"), found.filter("main IS NOT NULL").select("host", "main")
    # the order of a group's tokens in each page
    group = small(members.select(F.col("host").alias("_host"), F.col("article").alias("_article"), F.col("token").alias("_token"), "anchor"), BROADCAST)
    places = items.join(group, (F.col("host") == F.col("_host")) & (F.col("article") == F.col("_article")) & (F.col("token") == F.col("_token")))
    order = places.select("host", "article", "content", "anchor", "token", F.explode("at").alias("at")).groupBy("host", "article", "content", "anchor")
    order = order.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("order"))
    order = order.withColumn("_n", F.size(F.array_distinct("order"))).withColumn("_once", F.slice("order", F.lit(1), F.col("_n")))
    order = order.withColumn("_even", F.col("order") == F.flatten(F.array_repeat("_once", (F.size("order") / F.col("_n")).cast("int"))))
    valid = order.groupBy("host", "article", "anchor").agg((F.min("_even") & (F.min(F.xxhash64("_once")) == F.max(F.xxhash64("_once")))).alias("_valid")).filter("_valid")
    fixed = members.filter("is_text").join(valid, ["host", "article", "anchor"])
    fixed = fixed.withColumn("_here", F.sum("chars").over(Window.partitionBy("host", "article", "parent"))).withColumn("_there", F.sum("chars").over(Window.partitionBy("host", "article")))
    fixed = fixed.filter(F.when(F.col("article"), F.col("_there") * 2 < F.col("all_chars")).otherwise((F.col("_here") * 2 < F.col("path_chars")) | (F.col("_here") == F.col("path_chars"))))
    lists = frequent.filter((F.col("token") != ROOT) & ~F.col("is_text") & ~F.col("article") & (F.col("chars") > 0) & (F.col("links") >= LINKS * F.col("chars")))
    none = F.lit(None).cast("long")
    found = fixed.select("host", F.col("token").alias("text"), none.alias("list"), none.alias("main"))
    found = found.unionByName(lists.select("host", none.alias("text"), F.col("token").alias("list"), none.alias("main"))).unionByName(mains.select("host", none.alias("text"), none.alias("list"), "main"))
    return stored(found.groupBy("host").agg(F.collect_list("text").alias("template_text"), F.collect_list("list").alias("link_lists"), F.max("main").alias("main_path")), "templates")


def main_text(html: str | None, template_text=(), link_lists=(), main_path: int | None = None) -> str:
    blocks, paths = parse(html)
    own = slots(blocks)
    lists, fixed = frozenset(link_lists or ()), frozenset(template_text or ())
    inside: dict[int, bool] = {ROOT: False}

    def is_inside(path: int) -> bool:
        way = []
        while path not in inside and path != main_path:
            way.append(path)
            path = paths[path][0]
        found = path == main_path or inside[path]
        inside.update(dict.fromkeys(way, found))
        return found

    chosen = main_path in paths
    return " ".join(b.text for b in own if (b.main or b.path not in lists and (not chosen or b.heading or is_inside(b.path))) and (not fixed or text_token(b) not in fixed))


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            texts = [main_text(html.as_py(), *template) for html, *template in zip(part.column(2), *(part.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null html and html without article text give an empty text. Pages whose url has no host (null included) have no template. Repeated rows
    give a row each. Other columns are ignored; no rows give no rows. A very long page is parsed whole by one task.
    """
    host, _ = host_and_path(F.col("url"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    templates = deduce(pages.filter("host <> ''")).withColumnRenamed("host", "_host")
    joined = pages.join(small(templates, BROADCAST), F.col("host") == F.col("_host"), "left")
    return joined.select("page_id", "url", "html", "template_text", "link_lists", "main_path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
