"""Main text of web pages by site template removal.

A lenient scanner turns a page into a tree of elements. Element subtrees are hashed bottom-up in four ways, and
Spark counts on how many pages of a host each hash occurs:

* content: tag, attributes, text and children, of every block that holds text, outside the main content;
* content of blocks inside an ``article`` or ``main``, counted by different articles of the host, not pages;
* frame: tag, class, id and the frames of the children, with runs of like ones as one and without text or links, of
  containers outside the main content (of lists and tables if all their text is links); with it goes the share
  of the page's text that it holds where no article or main tells where the text is;
* slot: tag, class, id and role of elements whose names say advert, notice, sidebar, menu, comment and the like.

What recurs is the host's template and is deleted: contents and frames on at least ``MIN_PAGES`` pages and
``SHARE`` of the host's pages (frames that hold more than ``FRAME_TEXT`` of the text on average stay), slots on two
pages and ``SLOT_SHARE``. What holds an article or main never goes. Blocks inside an article go only if they are at
most half of it, so an article printed on several pages of a host, with small changes or none, stays whole on
each; pages without article or main count once if they are alike, for contents and frames. Of what is left, elements that are never text by
their kind (heads, scripts, styles, forms, navigation, asides, page headers and footers) are dropped.

On hosts of fewer than ``MIN_PAGES`` pages nothing can be counted. There kinds and names decide alone, and the text
is what ``article`` elements hold, else ``main``, else the body.

A host has at most (subtrees of a page) / share template hashes, so the list a page is compared with is bounded
however large its host is. The table of all hosts' templates is broadcast only if its bytes are few, else it is
joined by host and salt, so that a large host meets many tasks.

Defined results: null html counts as empty and gives an empty text; a page whose url has no host has no
template; unclosed, misnested and cut-off markup is read as far as it goes, in time linear in the page (once a tag's
quotes have run off the end of a page, quotes in later tags mean nothing); repeated rows are pages of their own; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, named, text_slices

MIN_PAGES = 5
SHARE = 0.3
SLOT_SHARE = 0.01
FRAME_TEXT = 0.3
#: Kinds of hashes, and what sets them apart in one list.
BESIDE, INSIDE, FRAME, SLOT = range(4)
APART = (0, 0x5BD1E995C6A4A793, 0x2127599BF4325C37, 0x165667B19E3779F9)
#: Templates of so many bytes may be broadcast.
BROADCAST_BYTES = 8_000_000
SALTS = 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Never part of the text.
DROPPED = frozenset("head script style noscript template iframe svg canvas object applet audio video map form button select option textarea input nav aside footer menu dialog title xmp noembed noframes".split())
#: Words in a class or id, and roles, that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs comment comments respond disqus replies share sharing social related newsletter subscribe popup modal footer pagination pager widget skip".split()
)
#: Those of them that an article element itself may carry; the others name its layout or subject.
ARTICLE_MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments respond replies related sidebar teaser".split())
#: A name that begins so says what is beside the element, not what it is.
ABOUT = frozenset("has no with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
CLOSED_BY_BLOCK = "p"
#: Blocks that running text is made of; their frames say nothing.
FLOW = frozenset("address blockquote dd dt figcaption figure h1 h2 h3 h4 h5 h6 hr html body li p pre td th tr tbody thead tfoot".split())
#: Their frames count if all their text is links.
LISTS = frozenset("dl menu ol table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: A tag without angle brackets inside its quotes.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/><]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
TAG_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")
NAME_WORDS = re.compile(r"[a-z0-9]+")
NUMBER = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "digest", "frame", "size", "linked")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.digest = self.frame = self.size = 0
        self.linked = True  # no text outside links


class Open:
    """The open elements, with the places of each tag and of blocks, so that no search runs over the stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str] | None]:
    """(start, end, whether it ends an element, name, attributes) of each tag, and of comments with an empty name; the caller may send where to go on."""
    at, end, last, quotes = 0, len(html), html.rfind(">"), True
    while 0 <= (at := html.find("<", at)) < end:
        lead = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            found = (at, stop + 3 if stop >= 0 else end, False, "", "")
        elif lead and lead in "!?":
            stop = html.find(">", at)
            found = (at, stop + 1 if stop >= 0 else end, False, "", "")
        elif at > last:
            return
        elif m := TAG.match(html, at):
            found = (at, m.end(), bool(m[1]), m[2], m[3])
        elif m := TAG_NAME.match(html, at):
            stop = m.end()
            while quotes and (x := STOP.search(html, stop)) and x[0] != ">":
                stop = html.find(x[0], x.end()) + 1
                if not stop:
                    x = None
                    break
            else:
                x = x if quotes else None
            quotes = quotes and x is not None
            stop = x.start() if x else html.find(">", m.end())
            if stop < 0:
                at += 1
                continue
            found = (at, stop + 1, bool(m[1]), m[2], html[m.end() : stop])
        else:
            at += 1
            continue
        at = (yield found) or found[1]


def parse(html: str) -> Node:
    """The tree of a page; texts keep their character references."""
    root = Node("#page")
    held, stack = (opened := Open(root)), opened.stack
    at, end = 0, len(html)
    found = tags(html)
    token = next(found, None)
    while token:
        start, stop, closing, name, attributes = token
        if start > at:
            stack[-1].children.append(html[at:start])
        at, tag = stop, name.lower()
        if closing:
            if place := held.last((tag,)):
                held.close(place)
        elif tag:
            if tag in BLOCKS and (place := held.last((CLOSED_BY_BLOCK,))) and place >= (held.blocks[-1] if held.blocks else 0):
                held.close(place)  # formatting left open inside a paragraph goes with it
            if tag in SIBLINGS and (place := held.last(SIBLINGS[tag])) > held.last(SCOPES[tag]):
                held.close(place)
            node = Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(html, at)
                node.children.append(html[at : close.start() if close else end])
                at = close.end() if close else end
            elif not (tag in VOID or attributes.endswith("/") and tag not in BLOCKS):
                held.push(node)
        try:
            token = found.send(at)
        except StopIteration:
            break
    if at < end:
        stack[-1].children.append(html[at:])
    return root


def attribute(node: Node, name: str) -> str | None:
    """The value of an attribute, empty if it has none, None if it is not there."""
    if name not in node.attributes.lower():
        return None
    for m in ATTRIBUTE.finditer(node.attributes):
        if m[1].lower() == name:
            return (m[2] or "").strip("\"'")
    return None


def marks(node: Node) -> set[str]:
    """The words of its class and id."""
    names = " ".join(attribute(node, a) or "" for a in ("class", "id")).lower()
    words = (NAME_WORDS.findall(name) for name in names.split())
    return {w for name in words if name and name[0] not in ABOUT for w in name}


def boilerplate(node: Node, in_main: bool, by_name: bool = True) -> bool:
    """Whether a subtree is no text by its kind or, with by_name, by its class, id or role."""
    tag = node.tag
    if tag in DROPPED or tag == "header" and not in_main:
        return True
    if not node.attributes or tag in ("html", "body", "main"):
        return False
    if attribute(node, "hidden") is not None or "display:none" in (attribute(node, "style") or "").replace(" ", "").lower():
        return True
    if not by_name:
        return False
    if tag == "article":
        return not ARTICLE_MARKS.isdisjoint(marks(node))
    return not MARKS.isdisjoint(marks(node)) or (attribute(node, "role") or "").lower() in ROLES


def names(node: Node) -> str:
    """Its class and id, with numbers alike."""
    return NUMBER.sub("0", " ".join(filter(None, (attribute(node, a) for a in ("class", "id"))))) if node.attributes else ""


def digest(node: Node) -> int:
    """Hash a subtree bottom-up, without recursion; content and frame digests and sizes of texts stay at the nodes."""
    import xxhash

    todo = [(node, False)]
    while todo:
        x, ready = todo.pop()
        if not ready:
            todo.append((x, True))
            todo.extend((c, False) for c in x.children if isinstance(c, Node))
            continue
        h = xxhash.xxh64(f"{x.tag}\0{' '.join(x.attributes.split())}")
        shape: list = []
        for c in x.children:
            if isinstance(c, Node):
                h.update(f"\0{c.digest}")
                x.size += c.size
                x.linked = x.linked and c.linked
                part = c.frame if c.tag in BLOCKS else "a" if c.tag == "a" else "t"
            else:
                text = " ".join(c.split())
                h.update(f"\1{text}")
                x.size += len(text)
                x.linked = x.linked and not text
                part = "t" if text else None
            if part is not None and (not shape or shape[-1] != part):
                shape.append(part)
        if x.tag == "a":
            x.linked = True
        x.digest = h.intdigest() - (1 << 63)
        if x.tag in BLOCKS:
            x.frame = xxhash.xxh64(f"{x.tag}\0{names(x)}\0{shape}").intdigest() - (1 << 63)
    return node.digest


def framed(x: Node) -> bool:
    """Whether its frame counts."""
    return x.tag in BLOCKS and x.tag not in FLOW and bool(x.children) and (x.tag not in LISTS or x.linked)


def slot(x: Node) -> int | None:
    """The hash of an element that is marked as boilerplate by its names."""
    if not x.attributes or x.tag in ("html", "body", "main"):
        return None
    role = (attribute(x, "role") or "").lower()
    if (ARTICLE_MARKS if x.tag == "article" else MARKS).isdisjoint(marks(x)) and (role not in ROLES or x.tag == "article"):
        return None
    import xxhash

    return xxhash.xxh64(f"{x.tag}\0{names(x)}\0{role}").intdigest() - (1 << 63)


def walk(root: Node) -> Iterator[Node]:
    """Element nodes in page order."""
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(c for c in reversed(x.children) if isinstance(c, Node))


def holders(root: Node) -> set[Node]:
    """The elements that are or hold an article or main."""
    out: set[Node] = set()
    for x in reversed(list(walk(root))):  # children before their parents
        if x.tag in ("article", "main") or any(c in out for c in x.children if isinstance(c, Node)):
            out.add(x)
    return out


def template_candidates(html: str) -> list[tuple[int, int | None, dict[int, float]]]:
    """What a page adds to the counts, as (kind of hash, unit, hashes with their shares of the page's text).

    A hash counts once a page, but once for each different unit where there is one: the hash of an article (of a main
    if there is none) for blocks inside it, the hash of the whole page where it has neither."""
    root = parse(html)
    digest(root)
    holding = holders(root)
    held = [x for x in walk(root) if x.tag in ("article", "main") and not boilerplate(x, False)]
    kind = "article" if any(x.tag == "article" for x in held) else "main"
    tops = [x for x in held if x.tag == kind]
    out: list[tuple[int, int | None, dict[int, float]]] = []
    frames: dict[int, float] = {}
    slots = {s: 0.0 for x in walk(root) if x not in holding and (s := slot(x)) is not None}
    for top in [root, *tops]:
        found: dict[int, float] = {}
        todo = [top]
        while todo:
            x = todo.pop()
            if x is not top and x.tag in ("article", "main"):
                continue
            if x.tag in BLOCKS and x.children and x.tag not in ("html", "body") and x not in holding:
                found[x.digest ^ APART[BESIDE if top is root else INSIDE]] = 0.0
                if top is root and framed(x):
                    frames[x.frame ^ APART[FRAME]] = frames.get(x.frame ^ APART[FRAME], 0.0) + (0.0 if holding else x.size / max(1, root.size))
            todo.extend(c for c in x.children if isinstance(c, Node))
        out.append((BESIDE, None if holding else root.digest, found) if top is root else (INSIDE, top.digest, found))
    return [*out, (FRAME, None if holding else root.digest, frames), (SLOT, None, {s ^ APART[SLOT]: 0.0 for s in slots})]


def carries(top: Node, template: set[int]) -> bool:
    """Whether an article has recurring parts but is more than those: a copy with small changes stays whole."""
    size = gone = 0
    todo: list = [(top, False)]
    while todo:
        x, recurs = todo.pop()
        if isinstance(x, str):
            n = len("".join(x.split()))
            size, gone = size + n, gone + n * recurs
        elif x is top or not boilerplate(x, True):
            recurs = recurs or x is not top and x.digest ^ APART[INSIDE] in template
            todo.extend((c, recurs) for c in x.children)
    return 0 < gone <= size / 2


def articles(root: Node) -> list[Node]:
    """The outermost elements that hold the text, where kinds and names alone decide."""
    kept: list[Node] = []
    # Names may mislead about what holds the article, so a second look goes by kind alone.
    for wanted, by_name in (("article", True), ("main", True), ("article", False), ("main", False)):
        todo = [root]
        while todo:
            x = todo.pop()
            if x.tag == wanted and not boilerplate(x, False, by_name):
                kept.append(x)
            elif not boilerplate(x, False, by_name):
                todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
        if kept:
            break
    return kept


def main_text(html: str | None, template: frozenset[int] | set[int], judged: bool = False) -> str:
    """The text of a page less its host's template; not judged: nothing could be counted on its host."""
    import html as entities

    root = parse(html or "")
    kept = [] if judged else articles(root)
    holding: set[Node] = set()
    if judged:
        digest(root)
        holding = holders(root)
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := " ".join(entities.unescape("".join(run)).split()):
            blocks.append(text)
        run.clear()

    def recurs(x: Node, inside: bool, cleared: bool) -> bool:
        if inside:
            if cleared and x.digest ^ APART[INSIDE] in template:
                return True
        elif x.digest in template or framed(x) and x.frame ^ APART[FRAME] in template:
            return True
        s = slot(x)
        return s is not None and s ^ APART[SLOT] in template

    for top in kept or [root]:
        # (element or text, whether it is inside an article or main, whether recurring blocks go from there); None closes a block.
        todo: list = [(top, bool(kept), False)]
        while todo:
            x, inside, cleared = todo.pop()
            if x is None:
                close()
                continue
            if isinstance(x, str):
                run.append(x)
                continue
            if x.tag in ("br", "wbr"):
                run.append(" " if x.tag == "br" else "")
                continue
            if judged:
                main = x.tag in ("article", "main")
                gone = boilerplate(x, inside, False) or (template and x not in holding and recurs(x, inside, cleared)) or (x.tag == "article" and (s := slot(x)) is not None and s ^ APART[SLOT] in template)
                if main and not inside:
                    inside, cleared = True, bool(template) and carries(x, template)
            else:
                gone = x is not top and boilerplate(x, bool(kept))
            if gone:
                if x.tag in BLOCKS:
                    close()
                continue
            if x.tag in BLOCKS or x.tag == "#page":
                close()
                todo.append((None, inside, cleared))
            todo.extend((c, inside, cleared) for c in reversed(x.children))
        close()
    return "\n".join(blocks)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """host, template (array<long>) of each host that has enough pages; the template may be empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, "html"):
                found = [(h, *x) for h, t in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True) for x in template_candidates(t or "")]
                shares = pa.array([list(x.items()) for *_, x in found], pa.map_(pa.int64(), pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, *_ in found], pa.string()), pa.array([k for _, k, _, _ in found], pa.int32()), pa.array([u for _, _, u, _ in found], pa.int64()), shares], ["host", "kind", "unit", "found"])

    hosts = pages.select(host_of(named(url_col)).alias("host"), named(html_col).alias("html")).filter("host <> ''")
    rows = hosts.mapInArrow(run, "host string, kind int, unit long, found map<long,double>")
    # A row without subtree stands for the page or article itself, so one aggregation counts both.
    entries = F.concat(F.map_entries("found"), F.array(F.struct(F.lit(None).cast("long").alias("key"), F.lit(0.0).alias("value"))))
    rows = rows.select("host", "kind", "unit", F.explode(entries).alias("x")).select("host", "kind", "unit", F.col("x.key").alias("subtree"), F.col("x.value").alias("held"))
    once = rows.groupBy("host", "kind", "unit", "subtree").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"))
    counted = once.groupBy("host", "kind", "subtree").agg(F.sum(F.when(F.col("unit").isNull(), F.col("n")).otherwise(1)).alias("n"), F.sum(F.when(F.col("unit").isNull(), F.col("held")).otherwise(F.col("held") / F.col("n"))).alias("held"))
    is_slot = F.col("kind") == SLOT
    counts = materialize(counted.filter(F.col("subtree").isNull() | (F.col("n") >= F.when(is_slot, 2).otherwise(min_pages))), "html-counts")
    totals = counts.filter("subtree IS NULL").select("host", "kind", F.col("n").alias("all"))
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    often = counts.filter("subtree IS NOT NULL").withColumn("salt", F.pmod("subtree", F.lit(SALTS)).cast("int")).join(salted, ["host", "kind", "salt"])
    often = often.filter(F.when(is_slot, F.col("n") >= F.col("all") * SLOT_SHARE).otherwise(F.col("n") >= F.col("all") * share) & ((F.col("kind") != FRAME) | (F.col("held") <= F.col("n") * FRAME_TEXT)))
    lists = often.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("template"))
    judged = totals.filter((F.col("kind") == FRAME) & (F.col("all") >= min_pages)).select("host")
    return judged.join(lists, "host", "left").select("host", F.coalesce("template", F.array().cast("array<bigint>")).alias("template"))


def text_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    templates = materialize(site_templates(pages, url_col, html_col, min_pages, share), "html-templates")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[str, frozenset] = {}
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = []
                for html, host, template in zip(*(part.column(c).to_pylist() for c in ("html", "host", "template")), strict=True):
                    if template and host not in known:
                        known = {host: frozenset(template)} if len(known) > 1000 else known | {host: frozenset(template)}
                    texts.append(main_text(html, known[host] if template else frozenset(), template is not None))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).alias("url"), named(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    size = templates.agg(F.sum(F.octet_length("host") + 8 * F.size("template") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(templates), "host", "left")
    else:
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "host", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
