"""Main text of web pages: containers are scored on each page, hosts vote on paths, pages are extracted by their host's path."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadprep.llm.scratch import settled
from roadprep.llm.shards import slices

#: A page's own container is its deepest one that holds this share of its text, and what stands with it (see Page.best).
SHARE = 0.8
#: Mean length of blocks from which text beside the container is text of the article.
DENSE_BLOCK = 80
#: A host's paths are those with one of so many of its votes at least: bounds their number and needs no common row.
VOTES_PER_PATH = 100
_WHOLE = frozenset(("", "html", "body"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Paths of all hosts up to which they are broadcast to the pages (12 bytes each); beyond it the join is left to a shuffle.
BROADCAST_PATHS = 1_000_000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile(r"[>\"']")
_COMMENT_END = re.compile(r"--!?>")
# Fixed values of HTML: elements whose content is no markup.
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "iframe", "textarea", "title")}
_CLASS = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

# Fixed values of HTML: elements that hold no text, inline elements, elements that are no part of an article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FORMULA = "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle mpadded mphantom semantics annotation annotation-xml"
_INLINE = frozenset(f"{_FORMULA} a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img br".split())
_CONTAINERS = frozenset("html body div article main section center table tbody tr td th ul ol dl blockquote figure details fieldset nav header footer aside form menu dialog pre".split())
_DROPPED_TAGS = frozenset("nav header footer aside form menu dialog head noscript template svg annotation annotation-xml object select button".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_DROPPED_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead banner ad ads adv advert adverts advertisement sponsor sponsored promo promotion "
    "notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup comment comments respond replies disqus discussion related recommended share sharing social pagination pager toolbar widget".split()
)
_KEPT_TAGS = frozenset("html body article main".split())
#: Names that mean a part of the article as well as what stands beside it: inside article or main such an element is
#: dropped only if it is no prose (see Page.settle).
_DOUBTFUL_NAMES = frozenset("header related discussion recommended banner notice notices aside promotion toolbar widget".split())
#: Share of a doubtful element's text inside links from which it is a list of links.
LINKS = 0.3


def tokens(html: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closing, tag, attributes) of each tag and of what is no text, whose tag is None; `raw` for elements
    whose content goes with them.

    A tag ends at the first > outside quotes, or at the first one at all if there is none. Linear: a place from which
    quotes run to the end of the page is remembered, so no later tag scans from it again.
    """
    last, dead = html.rfind(">"), set()

    def tag_end(at: int) -> int:
        seen = []
        while (m := _SPECIAL.search(html, at)) and m.start() not in dead:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            at = html.find(m[0], m.end()) + 1
            if not at:
                break
        dead.update(seen)
        return -1

    at = 0
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith("<!--", start):
            m = _COMMENT_END.search(html, start + 4)
            at = m.end() if m else len(html)
            yield start, at, False, None, ""
            continue
        if start > last:  # no tag ends any more; comments may begin
            at = html.find("<!--", at)
            if at < 0:
                return
            continue
        closing = html.startswith("/", at)
        name = _NAME.match(html, at + closing)
        if not name:
            if closing or html[at : at + 1] in ("!", "?"):
                at = html.find(">", at) + 1
                yield start, at, closing, None, ""
            continue
        end = tag_end(name.end())
        if end < 0:
            end = html.find(">", name.end())
            if end >= 0:
                at = end + 1
                yield start, at, closing, None, ""
            continue
        tag, at = name[0].lower(), end + 1
        if not closing and tag in _RAW:
            m = _RAW[tag].search(html, at)
            at = m.end() if m else len(html)
            yield start, at, False, "raw", ""
        else:
            yield start, at, closing, tag, html[name.end() : end]


def _names(attributes: str) -> tuple[list[str], str]:
    """The words of class and id, and the role."""
    words: list[str] = []
    role = ""
    for key, value in _CLASS.findall(attributes):
        value = value.strip("\"'").lower()
        if key.lower() == "role":
            role = value
        else:
            words += value.split()
    return words, role


def _dropped(tag: str, words: list[str], role: str, attributes: str) -> int:
    """2 for an element that is no part of the article, 1 if its name says so that can name a part of it, too, else 0."""
    if tag in _KEPT_TAGS:
        return 0
    if tag in _DROPPED_TAGS or role in _DROPPED_ROLES or (attributes and _HIDDEN.search(attributes)):
        return 2
    found = 0
    for word in words:
        parts = set(re.split(r"[-_\d]+", word))
        names = _DROPPED_NAMES & parts
        if names and not {"with", "has", "no", "without"} & parts:
            # a name alone is what it says; with other words it can be a part of an article about it
            found = max(found, 1 if names <= _DOUBTFUL_NAMES and len(parts - {""}) > 1 else 2)
    return found


def general(tag: str, words: list[str]) -> str:
    """An element's step in a path: tag and class words, without digits."""
    kept = sorted({w for w in (re.sub(r"\d+", "", x).strip("-_") for x in words) if w})
    return ".".join([tag, *kept])


def step(above: bytes, tag: str, words: list[str]) -> bytes:
    """The digest of a path, from that of the path above it: paths are compared, and of one size however deep."""
    return blake2b(above + b"/" + general(tag, words).encode(), digest_size=12).digest()


class Page:
    """Blocks of text of one page, each with the containers that it stands in."""

    def __init__(self, html: str):
        self.paths: list[bytes] = [b""]  # digest of the general path of each container; 0 is the page
        self.parent: list[int] = [0]
        self.tags: list[str] = [""]
        self.blocks: list[tuple[int, str]] = []
        self.heading: list[bool] = []  # of each block
        self.doubt: list[int] = []  # of each block: the number of the doubtful element that it stands in, 0 for none
        self.linked: Counter[int] = Counter()  # characters inside links by doubtful element
        element = ""
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, dropped
        doubts: list[tuple[int, int]] = []  # doubtful elements that are open: depth on the stack, number
        n_doubts = links = 0
        open_tags: Counter[str] = Counter()  # of the stack: an end tag without a start is not searched for
        buffer: list[str] = []
        position = 0

        def flush():
            if buffer:
                text = "".join(buffer)
                buffer.clear()
                if "&" in text:
                    text = unescape(text)
                text = " ".join(text.split())
                if text:
                    self.blocks.append((stack[-1][1], text))
                    self.heading.append(element in _HEADINGS)
                    self.doubt.append(doubts[0][1] if doubts else 0)

        def push(tag: str, container: int, dropped: bool):
            stack.append((tag, container, dropped))
            open_tags[tag] += 1

        def cut(k: int):
            while len(stack) > k:
                open_tags[stack.pop()[0]] -= 1
            while doubts and doubts[-1][0] >= len(stack):
                doubts.pop()

        def judged(tag: str, words: list[str], role: str, attributes: str) -> bool:
            """Whether an element goes at once; a doubtful one inside an article is open for judgement."""
            nonlocal n_doubts
            found = _dropped(tag, words, role, attributes)
            if found == 1 and tag in _CONTAINERS and (open_tags["article"] or open_tags["main"]):
                n_doubts += 1
                doubts.append((len(stack), n_doubts))
                return False
            return found > 0

        for start, end, closing, tag, attributes in tokens(html):
            if start > position and not stack[-1][2]:
                buffer.append(html[position:start])
                if links and doubts:
                    self.linked[doubts[0][1]] += start - position
            position = end
            if tag is None:
                continue
            if tag == "raw":
                flush()
                continue
            if tag == "a":
                links = 0 if closing else 1
            if closing:
                inline = tag in _INLINE
                if not inline:
                    flush()
                    element = ""
                if open_tags[tag]:
                    for k in range(len(stack) - 1, 0, -1):  # an inline element is on the stack only if it is dropped
                        if stack[k][0] == tag:
                            cut(k)
                            break
                        if inline and stack[k][0] in _CONTAINERS:
                            break
                continue
            if tag in _INLINE:
                if tag == "br":
                    buffer.append(" ")
                elif attributes and tag not in _VOID and not attributes.endswith("/"):
                    words, role = _names(attributes) if "=" in attributes else ([], "")
                    if not stack[-1][2] and _dropped(tag, words, role, attributes):
                        push(tag, stack[-1][1], True)
                elif tag in _DROPPED_TAGS:
                    push(tag, stack[-1][1], True)
                continue
            flush()
            element = tag
            if tag in _VOID:
                continue
            if stack[-1][0] == "p" or stack[-1][0] == tag == "li":
                cut(len(stack) - 1)
            words, role = _names(attributes) if "=" in attributes else ([], "")
            dropped = stack[-1][2] or judged(tag, words, role, attributes)
            if tag in _CONTAINERS:
                container = stack[-1][1]
                if not dropped:
                    self.paths.append(step(self.paths[container], tag, words))
                    self.parent.append(container)
                    self.tags.append(tag)
                    container = len(self.paths) - 1
                push(tag, container, dropped)
            elif dropped:
                push(tag, stack[-1][1], True)
        if position < len(html) and not stack[-1][2]:
            buffer.append(html[position:])
        flush()
        self.settle()

    def settle(self) -> None:
        """Blocks of doubtful elements stay where the element is prose: text outside links, in blocks of some length or
        with a heading; a list of links, or short labels, goes."""
        size, number, headed = Counter(), Counter(), set()
        for (_, text), heading, d in zip(self.blocks, self.heading, self.doubt):
            if d:
                size[d] += len(text)
                number[d] += 1
                if heading:
                    headed.add(d)
        bad = {d for d in size if self.linked[d] >= LINKS * size[d] or (d not in headed and size[d] < DENSE_BLOCK * number[d])}
        if bad:
            kept = [k for k, d in enumerate(self.doubt) if d not in bad]
            self.blocks, self.heading = [self.blocks[k] for k in kept], [self.heading[k] for k in kept]

    def totals(self) -> list[int]:
        """Characters of text inside each container."""
        out = [0] * len(self.paths)
        for container, text in self.blocks:
            out[container] += len(text)
        for c in range(len(out) - 1, 0, -1):
            out[self.parent[c]] += out[c]
        return out

    def best(self) -> int:
        """The container that core() gives, or an outer one if what that adds is text of the article: an enclosing article
        or main, headings and blocks right beside the container (in body, long ones), other containers with long blocks.

        One pass: each block outside the core is counted where its way up meets the core's, by the child it comes from.
        """
        core = self.core()
        above, c = [core], core
        while self.parent[c] != c:
            c = self.parent[c]
            above.append(c)
        on_way = set(above)
        side = list(range(len(self.paths)))  # the outermost container off the core's way that a container stands in
        sides: dict[int, dict[int, list[int]]] = {}
        for c in range(1, len(side)):
            if c not in on_way and self.parent[c] not in on_way:
                side[c] = side[self.parent[c]]
        for (c, text), heading in zip(self.blocks, self.heading):
            child = c if c in on_way else side[c]
            outer = c if c in on_way else self.parent[child]
            if outer != core:
                seen = sides.setdefault(outer, {}).setdefault(child, [0, 0])
                seen[0] += max(DENSE_BLOCK, len(text)) if heading else len(text)
                seen[1] += 1
        best, below = core, [0, 0]  # below: what lies between the best container and this one
        for inner, outer in zip(above, above[1:]):
            found = sides.get(outer, {}) | ({inner: below} if below[1] else {})
            good = all(total >= DENSE_BLOCK * n or (c == outer and self.tags[c] not in _WHOLE) for c, (total, n) in found.items())
            if self.tags[outer] in ("article", "main") or (found and good):
                best, below = outer, [0, 0]
            else:
                below = [sum(x[k] for x in found.values()) for k in (0, 1)]
        return best

    def core(self) -> int:
        """The deepest container with SHARE of the text; article and main need half of it only."""
        totals = self.totals()
        best = 0
        for c in range(1, len(totals)):
            need = SHARE / 1.6 if self.tags[c] in ("article", "main") else SHARE
            if totals[c] >= need * totals[0] and totals[c] and self.tags[c] not in ("ul", "ol", "dl", "tr", "blockquote", "pre", "figure"):
                best = c
        return best

    def text(self, paths: list[bytes]) -> str:
        """Blocks in the page's own container, or in the containers of the one of the host's paths that covers more.

        A page none of whose containers holds most of its text (its core is the whole page) takes the path of these that
        covers most of it, if that is 30 % at least, and all blocks of DENSE_BLOCK characters beside it: what goes is
        short. Without such a path the whole page stays.
        """
        totals = self.totals()
        best = self.best()
        whole = self.tags[self.core()] in _WHOLE
        chosen, most = {best}, 0.3 * totals[0] if whole else totals[best]
        places: dict[bytes, set[int]] = {}
        for c in range(1, len(self.paths)):
            if totals[c] and self.tags[c] not in _WHOLE:
                places.setdefault(self.paths[c], set()).add(c)
        for path in paths:
            found = places.get(path, set())
            covered = sum(totals[c] for c in found if self.parent[c] not in found)
            if found and covered > most:
                chosen, most = found, covered
        inside = [False] * len(self.paths)
        for c in range(len(self.paths)):
            inside[c] = c in chosen or (c > 0 and inside[self.parent[c]])
        beside = whole and best not in chosen
        return "\n\n".join(text for c, text in self.blocks if inside[c] or (beside and len(text) >= DENSE_BLOCK))


def host(url):
    """Lower-case host of a URL without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def vote(pages: DataFrame) -> DataFrame:
    """host, paths: digests of the general paths with a VOTES_PER_PATH-th of the votes on each host, those with most votes first.

    One pass over the pages gives a path for each; votes are counted by host and path, combined before the shuffle, so
    a host with a third of all pages sends one row for each path and task.
    """

    def paths(batches):
        for part in slices(batches, "html"):
            found = []
            for html in part.column("html").to_pylist():
                page = Page(html or "")
                best = page.best()
                found.append(None if page.tags[best] in _WHOLE else page.paths[best])  # a whole page is no container
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(found, pa.binary())], names=["host", "path"])

    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(paths, "host string, path binary").filter("path IS NOT NULL").groupBy("host", "path").count()
    of_host = votes.groupBy("host").agg(F.sum("count").alias("n_votes"))
    votes = votes.join(of_host, "host").filter(F.col("count") * VOTES_PER_PATH >= F.col("n_votes"))
    ranked = votes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "path"))).alias("best"))
    return ranked.select("host", F.col("best.path").alias("paths"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html).

    The text is the article's blocks joined by two line feeds, character references decoded, white space inside a
    block turned into one space. A null or empty html, or one without text, gives an empty text. Pages without a host
    vote together as one. Repeated rows stay rows; other columns are not read.
    """
    pages = pages.select("page_id", "url", "html")
    chosen = settled(vote(pages))
    n_paths = chosen.agg(F.sum(F.size("paths"))).first()[0] or 0
    keyed = pages.withColumn("_host", host(F.col("url")))
    right = chosen.withColumnRenamed("host", "_host")
    joined = keyed.join(F.broadcast(right) if n_paths <= BROADCAST_PATHS else right, "_host", "left")

    def texts(batches):
        for part in slices(batches, "html"):
            rows = zip(part.column("html").to_pylist(), part.column("paths").to_pylist())
            found = [Page(html).text([bytes(p) for p in paths or []]) if html else "" for html, paths in rows]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "paths").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
