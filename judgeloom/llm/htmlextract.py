"""Main text of web pages by consensus of the pages of a host.

Every page's containers are scored by the text of their blocks, less links. A page votes for its best
container, named by a generalised tag-class path (digits gone, classes lower-cased). Spark counts the votes of each
host; a host's winning paths are those with a good share of them. Then every page is read again with
its host's winning paths, or its own best container where it has none of them. A container found so names the article, and
is not its edge: the text is that of the outermost article or main around it; where there is none, blocks that stand
directly in a container around it (titles, leads) and sections beside it belong to it too, but no div or cell beside it, which may
be anything, and no block that is mostly links.

What is never text: scripts, styles, forms, menus, page headers and footers, sidebars, notices, adverts, reader
comments, and hidden elements - by tag, role, class or id. A class or id settles it only where all its words are such words or say
nothing (related-posts, ad-slot, cookie-notice); with another word beside them (related-work, modal-verbs) the element goes only if it is mostly links, and
so do paragraphs and other pieces of text inside an article or main, whatever their class. A header or aside inside an article or main goes if it
is mostly links or holds controls; a form that holds most of the page's text is its frame. No class
takes away an article or main, or what holds one, and where words or such tags would leave no text at all, they are ignored. White space inside a block is one space; blocks
are joined by an empty line.

Cases: null or empty html, or html without text, gives an empty text; cut-off html ends where it ends; an
unclosed comment or script swallows the rest, as in browsers; a null url is a host of its own (the empty one);
ties between containers go to the first in page order; repeated rows vote and return each; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .urlfilter import host_path

#: Winning paths of a host have at least this share of its pages' votes.
SHARE = 0.05
#: Winning paths of up to so many characters together are broadcast; beyond that the join shuffles.
BROADCAST_CHARS = 8_000_000
#: Longer path names are named by a hash.
PATH_CHARS = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend option".split())
#: Elements that hold a whole article, and parts of one that never stand for something else of the page.
WHOLE, PARTS = frozenset(["article", "main"]), frozenset(["section", "blockquote", "center"])
CONTAINERS = frozenset("article main section div td body blockquote center".split())
SKIPPED = frozenset("head nav header footer aside form button select menu template svg math canvas object dialog audio video map search datalist".split()) | RAW
#: Parts of a page's frame that may also stand inside an article, or around everything.
FRAMES = frozenset("header footer aside form".split())
CONTROLS = frozenset("input select textarea button".split())
#: Pieces of text: inside an article their classes don't settle anything.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr span b strong i em u small sup sub code q cite a".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_SURE = (
    r"ads|adbox|adsbox|advert\w*|sponsor\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|aside|widget\w*|footer\w*|site-header|page-header|masthead|topbar|comments?|commentlist|replies|respond|disqus\w*|cookies?|cookie\w*|"
    r"consent|gdpr|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|sharing|social\w*|related\w*|recommend\w*|pagination|pager|toolbar|sr-only|skip-?link|side-bar|pop-up|sign-up|comment-?list"
)
_UNSURE = r"ad|promo\w*|banner\w*|side|foot|header|reply|discussion|notice\w*|alert\w*|login|share|search\w*|form|hidden|copyright|legal|disclaimer"
#: Words that say nothing beside words that settle it.
_NEUTRAL = r"post|posts|user|reader|article|articles|story|stories|topics?|news|content|text|page|pages|policy|form|more|you|may|also|like|view|count"
#: Words that say nothing beside others.
_PLAIN = r"box|wrap|wrapper|container|list|bar|block|area|section|links?|buttons?|icons?|inner|outer|panel|items?|slot|unit|top|bottom|left|right|main|site|page|global|id|el|js|row|col|group|region|holder|zone|info|msg|message|note|field|input|small|large|big|mini|sticky|fixed|is|the|\d+"
SURE = re.compile(rf"(?:^|[-_\s])(?:{_SURE})(?=$|[-_\s])", re.I)
_settled = re.compile(rf"(?:(?:{_SURE}|{_UNSURE}|{_PLAIN}|{_NEUTRAL})(?:[-_]|$))+", re.I)
UNSURE = re.compile(rf"(?:^|[-_\s])(?:{_UNSURE})(?=$|[-_\s])", re.I)
_alone = re.compile(rf"(?:(?:{_UNSURE}|{_PLAIN})(?:[-_]|$))+", re.I)


def boiler(classes: str, name: str) -> int:
    """What an element's class and id say: 2 boilerplate, 1 perhaps, 0 nothing."""
    told = 0
    for word in [*classes.split(), *name.split()]:
        if SURE.search(word):
            told = 2 if _settled.fullmatch(word) else max(told, 1)
            if told == 2:
                return 2
        if UNSURE.search(word):
            told = 2 if _alone.fullmatch(word) else max(told, 1)
            if told == 2:
                return 2
    return told


_token = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_attr = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w=\"'-])(hidden)(?![\w=-])")
#: An open element of the key closes when one of these starts, unless one of its barriers is in between; a p closes at any block.
_CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "option": frozenset(["option"])}
_BARRIER = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"]), "option": frozenset(["select"])}


class Node:
    __slots__ = ("tag", "path", "depth", "parent", "score", "order")

    def __init__(self, tag, path, parent, order):
        self.tag, self.path, self.parent, self.order, self.score = tag, path, parent, order, 0.0


def _step(tag: str, classes: str) -> str:
    names = sorted({re.sub(r"\d+", "", c.lower()) for c in classes.split()} - {""})
    return ".".join([tag, *names])


def _path(of: Node, step: str) -> str:
    name = f"{of.path}>{step}"
    return name if len(name) <= PATH_CHARS else "#" + xxhash.xxh3_128_hexdigest(name.encode("utf-8", "surrogatepass"))


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """(innermost container, text, characters in links) of each block of the page, in order, without boilerplate."""
    for words, tags in ((True, True), (False, True), (False, False)):
        controls: set[int] = set()
        found = list(_blocks(page, words, tags, controls))
        # an element that is perhaps boilerplate, by its number (a form's is negative): its text and the part in links
        size: dict[int, list[int]] = {}
        for _, said, linked, inside in found:
            for k in inside:
                held = size.setdefault(k, [0, 0])
                held[0] += len(said)
                held[1] += linked
        all_ = sum(len(said) for _, said, _, _ in found)
        gone = {k for k, (n, linked) in size.items() if (2 * n < all_ if k < 0 else 2 * linked >= n or k in controls)}
        kept = [(node, said, linked) for node, said, linked, inside in found if not gone.intersection(inside)]
        if kept:
            return kept
    return []


class Stack:
    """Open elements, with the places of each tag's open ones, so that no search goes through the others."""

    def __init__(self):
        self.held: list[tuple] = []
        self.open: dict[str, list[int]] = {}

    def push(self, tag: str, *more) -> None:
        self.open.setdefault(tag, []).append(len(self.held))
        self.held.append((tag, *more))

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def cut(self, k: int) -> None:
        for tag, *_ in self.held[k:]:
            self.open[tag].pop()
        del self.held[k:]


def _blocks(page: str, words: bool, tags: bool, controls: set[int]) -> Iterator[tuple[Node, str, int, tuple[int, ...]]]:
    """Each block of the page with the numbers of the open elements that are perhaps boilerplate.

    words: whether classes and ids are read; tags: whether headers, footers, asides and forms are left out; controls gets the numbers of those that hold controls."""
    root = Node("body", "body", None, 0)
    # an open element: tag, container it puts its text in, whether it is skipped, what it may be of boilerplate
    stack = Stack()
    stack.push("", root, False, ())
    holds = _holders(page) if (words or tags) and _whole.search(page) else frozenset()
    text: list[str] = []
    linked, order, at = 0, 0, 0

    def flush():
        nonlocal text, linked
        said = " ".join(_html.unescape("".join(text)).split())
        n, text, linked = linked, [], 0
        return said, n

    def done():
        said, n = flush()
        return (stack.held[-1][1], said, n, stack.held[-1][3]) if said else None

    end = len(page)
    while at < end:
        m = _token.search(page, at)
        stop = m.start() if m else end
        if stop > at and not stack.held[-1][2]:
            part = page[at:stop]
            text.append(part)
            if stack.open.get("a"):
                linked += len(part)
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            k = stack.last(tag)
            if k > 0:
                if tag in BLOCKS and (block := done()):
                    yield block
                stack.cut(k)
            continue
        if tag in CONTROLS:
            controls.update(stack.held[-1][3])
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if tag in BLOCKS:
            if block := done():
                yield block
            # implied ends: an open p has no block inside
            if (k := stack.last("p")) > 0:
                stack.cut(k)
            if tag in _CLOSES and (k := stack.last(*(t for t, by in _CLOSES.items() if tag in by))) > stack.last(*_BARRIER[tag]):
                stack.cut(k)
        elif tag == "br":
            text.append("\n")
        if tag in VOID:
            continue
        _, holder, skipped, maybe = stack.held[-1]
        classes = ""
        if not skipped:
            raw = m["attrs"]
            attrs = {}
            if raw and not raw.isspace():
                for a in _attr.finditer(raw):
                    attrs.setdefault((a[1] or a[5]).lower(), a[2] or a[3] or a[4] or "")
                classes = attrs.get("class", "")
            within = stack.last(*WHOLE) > 0
            around = m.start() in holds
            if tag in FRAMES:
                if tags and not around:
                    if tag == "form":
                        maybe = (*maybe, -m.start() - 1)
                    elif within and tag != "footer":
                        maybe = (*maybe, m.start())
                    else:
                        skipped = True
            elif tag in SKIPPED:
                skipped = True
            if attrs and not skipped and tag not in ("html", "body"):
                told = boiler(classes, attrs.get("id", "")) if words and tag not in WHOLE and not around else 0
                if told == 2 and within and tag in TEXTS:
                    told = 1
                if told == 1:
                    maybe = (*maybe, m.start())
                style = attrs.get("style", "").replace(" ", "").lower()
                skipped = told == 2 or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        if not skipped and tag in CONTAINERS and tag != "body":
            order += 1
            holder = Node(tag, _path(holder, _step(tag, classes)), holder, order)
        stack.push(tag, holder, skipped, maybe)
    if block := done():
        yield block


_whole = re.compile(r"<(?:article|main)\b", re.I)


def _holders(page: str) -> frozenset[int]:
    """Where the tags begin of elements that are open around an article or main."""
    stack = Stack()
    found: set[int] = set()
    known: dict[int, bool] = {}
    at = 0
    while m := _token.search(page, at):
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or tag in VOID:
            continue
        if tag in RAW and not m["end"]:
            past = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = past.end() if past else len(page)
        elif m["end"]:
            if (k := stack.last(tag)) >= 0:
                stack.cut(k)
        else:
            if tag in WHOLE:
                # comments are articles of their own in some pages: what the words are sure of stays so
                for _, p in reversed(stack.held):
                    if p in known:
                        break  # and so is all around it
                    known[p] = True
                    if not SURE.search(_attributes(page, p)):
                        found.add(p)
            stack.push(tag, m.start())
    return frozenset(found)


def _attributes(page: str, at: int) -> str:
    """Class and id of the tag that begins there."""
    m = _token.match(page, at)
    got = {(a[1] or a[5]).lower(): a[2] or a[3] or a[4] or "" for a in reversed(list(_attr.finditer(m["attrs"] or "")))}
    return f"{got.get('class', '')} {got.get('id', '')}"


def best_path(page: str) -> str | None:
    """The path of the page's best container."""
    return _best(blocks(page))


def _best(found: list[tuple[Node, str, int]]) -> str | None:
    """The best container's path, by text in its blocks less links; half of it counts for the container around."""
    scores: dict[str, float] = {}
    first: dict[str, int] = {}
    for node, said, linked in found:
        worth = max(0, len(said) - 2 * linked) * (1.25 if node.tag in ("article", "main") else 1.0)
        scores[node.path] = scores.get(node.path, 0) + worth
        first.setdefault(node.path, node.order)
        if node.parent is not None:
            scores[node.parent.path] = scores.get(node.parent.path, 0) + worth / 2
            first.setdefault(node.parent.path, node.parent.order)
    return min(scores, key=lambda p: (-scores[p], first[p])) if scores else None


def _article(found: list[tuple[Node, str, int]], path: str) -> list[str]:
    """The texts of the article around the containers of a path, in page order; none without such a container."""
    # for each container: the outermost article or main around it (or itself), and whether it is inside one of the path
    outer: dict[int, tuple[Node | None, bool]] = {0: (None, False)}

    def of(node: Node | None) -> tuple[Node | None, bool]:
        chain = []
        while node is not None and id(node) not in outer:
            chain.append(node)
            node = node.parent
        at = outer[id(node)] if node is not None else outer[0]
        for n in reversed(chain):
            at = outer[id(n)] = (at[0] or (n if n.tag in WHOLE else None), at[1] or n.path == path)
        return at

    inside = [of(node) for node, _, _ in found]
    if not any(held for _, held in inside):
        return []
    wholes = {id(whole) for whole, held in inside if held and whole is not None}
    # containers around those of the path that are in no article or main
    around: set[int] = set()
    for (node, _, _), (whole, held) in zip(found, inside, strict=True):
        if held and whole is None:
            while node is not None and id(node) not in around:
                around.add(id(node))
                node = node.parent

    def beside(node: Node, said: str, linked: int) -> bool:
        if len(said) <= 2 * linked:
            return False
        while id(node) not in around and node.tag in PARTS:
            node = node.parent
        return id(node) in around

    return [said for (node, said, linked), (whole, held) in zip(found, inside, strict=True) if held or (id(whole) in wholes if whole is not None else beside(node, said, linked))]


def main_text(page: str, paths: list[str]) -> str:
    """The article around the first of the paths that the page has, or around its own best container."""
    found = blocks(page)
    for path in paths:
        if said := _article(found, path):
            return "\n\n".join(said)
    own = _best(found)
    return "\n\n".join(_article(found, own)) if own is not None else ""


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the paths with the most votes of each host's pages, best first."""

    def vote(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([b.column("host"), pa.array([best_path(h or "") for h in b.column("html").to_pylist()], pa.string())], ["host", "path"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string").where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))
    votes = written(votes, "votes")
    all_ = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    ranked = votes.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("place") <= round(1 / SHARE))
    good = ranked.join(all_, "host").where((F.col("votes") >= SHARE * F.col("all")) | (F.col("place") == 1))
    return good.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("p")).select("host", F.col("p.path").alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"), host_path(F.col(f"`{url_col}`").cast("string"))[0].alias("host"))
    paths = written(winning_paths(source), "paths")
    size = paths.agg(F.coalesce(F.sum(F.length("host") + F.length(F.array_join("paths", ",")) + 32), F.lit(0)).alias("n")).first()["n"]
    met = source.join(F.broadcast(paths) if size <= BROADCAST_CHARS else paths, "host", "left").select("page_id", "url", "html", "paths")
    kinds = {f: source.schema[f].dataType.simpleString() for f in ("page_id", "url")}

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            said = [main_text(h or "", p or []) for h, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(said, pa.string()), pa.array(map(len, said), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
