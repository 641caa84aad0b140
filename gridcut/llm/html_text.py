"""Main text of web pages: a host's suffix array judges the pages, with tags as evidence."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcut.llm.common import stored

#: Tokens of the shortest repeated run that counts, and the pages of a host that must share it.
RUN_TOKENS, RUN_PAGES = 8, 3
#: A host's pages are dealt into groups of about so many bytes of text; each has a suffix array.
GROUP_BYTES = 8 << 20

# Fixed values of HTML: elements that never hold article text, that hold raw text, that end a block,
# that have no end tag; and words in class, id or role that tell boilerplate.
DROPPED = frozenset(
    "head nav footer aside form button select menu dialog iframe svg object canvas figure-nav fieldset".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: A closed element of these does not reach beyond the second set; sections close whatever is open in them.
SPECIAL = (BLOCKS - {"option"}) | frozenset("body button iframe object select".split())
SCOPE = frozenset("applet button caption marquee object table td template th".split())
SECTIONS = frozenset("article aside footer form header main nav section".split())
TABLE_PARTS = frozenset("caption table tbody td tfoot th thead tr".split())
#: Which open elements a start tag ends, as HTML lets their end tags be left out.
ENDS_P = BLOCKS - frozenset("body caption head html legend optgroup option tbody td tfoot th thead title tr".split())
ENDS_ROWS = {
    **dict.fromkeys(("td", "th"), ("td", "th")),
    "tr": ("td", "th", "tr"),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ("td", "th", "tr", "tbody", "thead", "tfoot", "caption")),
}
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes".split())
#: Dropped by their tag also when an article stands in them, if their own end tag closes them.
TANGENT = DROPPED - frozenset("form fieldset dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TELLING = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup sidebar rail widget widgets menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar pagination pager share sharing "
    "social related recommended recommendations comment comments disqus respond replies complementary contentinfo search".split()
)
# Words that say of another word that a page or element has it, and words for what merely holds something.
STATES = frozenset("has have no not with without is show hide hidden enable enabled disable disabled for before after".split())
HOLDERS = frozenset(
    "area bar block bottom box button buttons card cards column container content contents footer form group header holder "
    "icon icons inner inside item items left link links list main outer panel primary right row secondary section slot "
    "small large space strip text title top unit wrap wrapper zone articles posts stories".split()
)
# Of the telling words those that make an article in such an element, or so named, one beside the main text.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar rail widget widgets related recommended "
    "recommendations comment comments disqus respond replies".split()
)
# Words that say the same of an article's own name.
TEASING = ASIDE | frozenset("teaser teasers card cards preview".split())
# End of the fixed values.

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*+)>?"
    r"|<[!?/][^>]*+>?",
    re.S | re.I,
)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
_UNSHOWN = re.compile(r"(?<![\w-])style\s*=\s*(?:\"[^\"]*|'[^']*|\S*)display\s*:\s*none", re.I)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Block:
    text: str
    article: bool
    dropped: bool


class _Open:
    """An open element; `drops` is settled at the end, `outer` is the dropped element around it."""

    __slots__ = ("name", "drops", "outer", "holds", "may_hold", "lifted", "own", "aside")

    def __init__(self, name: str) -> None:
        self.name, self.drops, self.outer, self.lifted, self.own, self.aside = name, False, None, True, False, False
        self.holds = self.may_hold = False


@dataclass
class _Reader:
    """Reads tags in order and keeps the open elements, with the end tags that HTML lets be left out.

    An element that is dropped ends at its end tag or with an element around it. If an article (or
    main) stands in it, it is not dropped after all; of TANGENT and hidden elements only if their own end
    tag is missing. An article in an element named as ASIDE says, or named so itself (TEASING), counts as
    one only if no other article or main stands on the page.
    """

    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    # Places in the stack, by name and for kinds of elements, so that no tag walks the stack.
    at: dict[str, list[int]] = field(default_factory=dict)
    scopes: list[int] = field(default_factory=list)
    special: list[int] = field(default_factory=list)
    items: list[int] = field(default_factory=list)
    tables: list[int] = field(default_factory=list)
    dropping: list[_Open] = field(default_factory=list)
    holding: int = 0
    may_holding: int = 0
    asides: int = 0
    plain: int = 0
    dropped: list[_Open] = field(default_factory=list)
    found: list[tuple[Block, _Open]] = field(default_factory=list)
    article: int = 0
    heading: int = 0

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            self.parts = []
            if text:
                block = Block(text, self.article > 0, False)
                self.blocks.append(block)
                by = self.dropping[-1] if self.dropping else None
                while by is not None and by.name == "header" and self.article and self.heading:
                    by = by.outer
                if by is not None:
                    self.found.append((block, by))

    def finish(self) -> list[Block]:
        self.end_block()
        self.pop_to(0, "")
        for e in self.dropped:  # an outer element stands before those in it
            held = e.holds or (e.may_hold and not self.plain)
            e.drops = not (held and (e.lifted or not e.own)) or (e.outer is not None and e.outer.drops)
        for block, by in self.found:
            block.dropped = by.drops
        return self.blocks

    def last(self, *names: str) -> int:
        return max((places[-1] for n in names if (places := self.at.get(n))), default=-1)

    def pop_to(self, place: int, closing: str) -> None:
        """Ends the elements from a place of the stack on; `closing` has an end tag of its own."""
        while len(self.stack) > place:
            e = self.stack[-1]
            if self.dropping and self.dropping[-1] is e:
                self.end_block()
                self.dropping.pop()
                e.own = len(self.stack) == place + 1 and closing == e.name
                self.holding = min(self.holding, len(self.dropping))
                self.may_holding = min(self.may_holding, len(self.dropping))
                self.asides -= e.aside
            self.stack.pop()
            self.at[e.name].pop()
            if e.name in SPECIAL or e.name in SCOPE:
                for places in (self.scopes, self.special, self.items, self.tables):
                    if places and places[-1] == len(self.stack):
                        places.pop()
            if e.name in ("article", "main"):
                self.article -= 1
            elif e.name in HEADINGS:
                self.heading -= 1

    def push(self, name: str, drops: bool, aside: bool = False, hidden: bool = False) -> None:
        """Opens an element; `aside` says that its name is one of ASIDE, or for an article of TEASING."""
        e, place = _Open(name), len(self.stack)
        drops = drops or hidden or (aside and name == "article")
        if drops:
            self.end_block()
            e.outer = self.dropping[-1] if self.dropping else None
            e.lifted = name not in TANGENT and not hidden
            e.aside = aside
            self.asides += aside
            self.dropping.append(e)
            self.dropped.append(e)
        self.stack.append(e)
        self.at.setdefault(name, []).append(place)
        if name in SCOPE:
            self.scopes.append(place)
        if name in SPECIAL:
            self.special.append(place)
            if name not in ("address", "div", "p"):
                self.items.append(place)
        if name == "table":
            self.tables.append(place)
        if name in ("article", "main"):
            self.article += 1
            if self.asides:
                for held in self.dropping[self.may_holding :]:
                    held.may_hold = True
                self.may_holding = len(self.dropping)
            else:
                for held in self.dropping[self.holding :]:
                    held.holds = True
                self.holding = len(self.dropping)
                self.plain += not hidden
        elif name in HEADINGS:
            self.heading += 1

    def imply(self, name: str) -> None:
        """Ends the elements that the start of another one ends."""
        if self.at.get("head") and name not in IN_HEAD:
            self.pop_to(self.last("head"), "")
        if name in ENDS_P and (p := self.last("p")) >= 0 and p > (self.scopes[-1] if self.scopes else -1):
            self.pop_to(p, "")
        over = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}.get(name)
        if over and self.items and self.stack[self.items[-1]].name in over:
            self.pop_to(self.items[-1], "")
        elif name in ENDS_ROWS:
            table = self.tables[-1] if self.tables else -1
            open_ = [k for n in ENDS_ROWS[name] if (k := self.last(n)) > table]
            if open_:
                self.pop_to(min(open_), "")
        elif name in ("option", "optgroup"):
            if (k := self.last("option")) > (self.special[-1] if self.special else -1):
                self.pop_to(k, "")
        elif name in HEADINGS and self.stack and self.stack[-1].name in HEADINGS:
            self.pop_to(len(self.stack) - 1, "")
        elif name in ("button", "select") and self.at.get(name):
            self.pop_to(self.last(name), "")

    def close(self, name: str) -> None:
        place = self.last(*HEADINGS) if name in HEADINGS else self.last(name)
        if name in SECTIONS:
            least = 0
        elif name in TABLE_PARTS:
            least = self.tables[-1] if self.tables else 0
        elif name in SPECIAL:
            least = self.scopes[-1] if self.scopes else 0
            if name == "li":
                least = max(least, self.last("ol", "ul"))
        else:
            least = self.special[-1] if self.special else 0
        if place >= least and place >= 0:
            self.pop_to(place, name)

    def text(self, part: str) -> None:
        if self.at.get("head") and not part.isspace():
            self.end_block()
            self.pop_to(self.last("head"), "")
        self.parts.append(part)

    def tag(self, closing: bool, name: str, rest: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name in BLOCKS:
            self.end_block()
        if name in VOID:
            self.imply(name)
            return
        if name in ("html", "body"):
            if not closing and not self.at.get(name):
                self.imply(name)
                self.push(name, False)
        elif closing:
            self.close(name)
        elif not (rest.endswith("/") and name not in BLOCKS):
            self.imply(name)
            told = rest and name != "main" and name not in HEADINGS and _telling(rest, TEASING if name == "article" else TELLING)
            aside = bool(told) and (name == "article" or _telling(rest, ASIDE))
            drops = name == "header" or name in DROPPED or bool(told)
            self.push(name, drops, aside, bool(rest) and _unshown(rest))


def _unshown(rest: str) -> bool:
    """Whether an element is hidden by its attribute or its own style."""
    low = rest.lower()
    return "hidden" in low and bool(_HIDDEN.search(_QUOTED.sub("", rest))) or "none" in low and bool(_UNSHOWN.search(rest))


def _telling(rest: str, telling: frozenset[str]) -> bool:
    """Whether a class name, id or role is a telling word or a compound whose head is one: its last word
    (site-header), or the first if only holders and numbers follow (ad-slot-2); not has-sidebar, comments-open."""
    for m in _NAMED.finditer(rest):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = [w for w in re.split(r"[_-]+", name) if w]
            while len(words) > 1 and words[-1].isdigit():
                words.pop()
            if not words or words[0] in STATES and len(words) > 1:
                continue
            if words[-1] in telling or words[0] in telling and HOLDERS.issuperset(words[1:]):
                return True
    return False


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks in page order: white space as one space, character references decoded."""
    page, reader, at = page or "", _Reader(), 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        if m[3]:
            reader.tag(m[2] == "/", m[3].lower(), m[4])
    if at < len(page):
        reader.text(page[at:])
    return reader.finish()


def windows(streams: list[list[int]], pages: list[int], tokens: int) -> tuple[np.ndarray, ...]:
    """Streams of token numbers laid end to end: where each begins, the tokens, and of the window of
    `tokens` tokens at each place its rank and the number of distinct pages that have it.

    Separators of their own end the streams, and suffixes are ranked by prefix doubling until ranks
    tell their first `tokens` tokens: the order of ranks is the suffix array, and suffixes of equal
    rank are its intervals with that common prefix.
    """
    lengths = np.array([len(s) for s in streams], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = np.empty(begin[-1], np.int64)
    page = np.empty(begin[-1], np.int64)
    top = 1 + max((max(s) for s in streams if s), default=0)
    for k, s in enumerate(streams):
        text[begin[k] : begin[k + 1] - 1] = s
        text[begin[k + 1] - 1] = top + k
        page[begin[k] : begin[k + 1]] = pages[k]
    if not len(text):
        return begin, text, text, text
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < tokens:
        step = min(depth, tokens - depth)
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    seen = np.unique(rank * (max(pages) + 1) + page)
    distinct = np.bincount(seen // (max(pages) + 1), minlength=len(rank))
    return begin, text, rank, distinct[rank]


def covered(begin: np.ndarray, hit: np.ndarray, tokens: int) -> list[np.ndarray]:
    """For each stream, which tokens lie in a window that was hit."""
    steps = np.zeros(begin[-1] + tokens + 1, np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + tokens, -1)
    inside = np.cumsum(steps)[: begin[-1]] > 0
    return [inside[begin[k] : begin[k + 1] - 1] for k in range(len(begin) - 1)]


def repeated(streams: list[list[int]], pages: list[int], tokens: int, least_pages: int) -> list[np.ndarray]:
    """For each stream of token numbers, which tokens lie in a run of `tokens` or more that occurs in
    `least_pages` or more distinct pages. A longer repeated run is made up of windows, one at each of
    its tokens."""
    begin, _, _, distinct = windows(streams, pages, tokens)
    return covered(begin, np.flatnonzero(distinct >= least_pages), tokens)


#: What tags say of a block: the host decides, it is dropped, or it stays.
OPEN, GONE, STAYS = 0, 1, 2
_BLOCKS = "row long, page_id long, url string, texts array<string>, kinds array<byte>, judged boolean"
_TEXT = "page_id long, url string, text string"


def _parsed(rows: DataFrame) -> DataFrame:
    """Every page's blocks with what tags say of them; `judged` if the host decides on any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                row, ids, urls, bodies = batch.slice(at, 500).columns
                found = [blocks_of(x.as_py()) for x in bodies]
                kinds = [[GONE if b.dropped else STAYS if b.article else OPEN for b in f] for f in found]
                cols = [
                    row,
                    ids,
                    urls,
                    pa.array([[b.text for b in f] for f in found], pa.list_(pa.string())),
                    pa.array(kinds, pa.list_(pa.int8())),
                    pa.array([OPEN in k for k in kinds], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "page_id", "url", "texts", "kinds", "judged"])

    return rows.mapInArrow(run, _BLOCKS)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _streams(group: pa.Table) -> tuple[list[list[int]], list[str]]:
    """The token stream of each page across its blocks, and the words by number."""
    vocab: dict[str, int] = {}
    streams = [
        [vocab.setdefault(w, len(vocab)) for t in texts.as_py() for w in t.split(" ")] for texts in group.column("texts")
    ]
    return streams, list(vocab)


def _names(text: np.ndarray, at: np.ndarray, words: list[str]) -> np.ndarray:
    """128-bit names of the windows at some places, the same in every group: rows of two numbers."""
    digests = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words)
    codes = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    out = np.zeros((len(at), 2), np.uint64)
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    for k in range(RUN_TOKENS):
        out = out * odd + codes[text[at + k]]
    return out.view(np.int64)


def _places(begin: np.ndarray) -> np.ndarray:
    """Places whose window lies within one stream."""
    ends = [np.arange(b, e - RUN_TOKENS) for b, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    return np.concatenate([*ends, np.empty(0, np.int64)]).astype(np.int64)


_COUNTED = "host_no long, group long, a long, b long, pages long, open boolean"


def group_runs(group: pa.Table) -> pa.Table:
    """The distinct windows of a group: their names, pages, and whether they touch a block that is open."""
    streams, words = _streams(group)
    begin, text, rank, distinct = windows(streams, list(range(len(streams))), RUN_TOKENS)
    touch = np.zeros(len(text) + 1, np.int64)
    at = 0
    for texts, kinds in zip(group.column("texts"), group.column("kinds"), strict=True):
        for t, kind in zip(texts.as_py(), kinds.as_py(), strict=True):
            n = t.count(" ") + 1
            touch[at + 1 : at + n + 1] = kind == OPEN
            at += n
        at += 1  # the separator
    touch = np.cumsum(touch)
    places = _places(begin)
    ranks, first, which = np.unique(rank[places], return_index=True, return_inverse=True)
    is_open = np.bincount(which, touch[places + RUN_TOKENS] - touch[places], minlength=len(ranks)) > 0
    names = _names(text, places[first], words) if len(places) else np.empty((0, 2), np.int64)
    same = [pa.array(np.full(len(ranks), group.column(c)[0].as_py(), np.int64)) for c in ("host_no", "group")]
    cols = [*same, pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(distinct[places[first]]), pa.array(is_open)]
    return pa.table(cols, names=["host_no", "group", "a", "b", "pages", "open"])


def unique_runs(group: pa.Table, shared: pa.Table) -> pa.Table:
    """Texts of a group's judged pages: blocks that stay, and open ones without what runs repeated on
    other pages cover, of the group or, by the names in `shared`, of the whole host."""
    if not group.num_rows:
        return pa.table([[], [], []], schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())]))
    streams, words = _streams(group)
    begin, text, _, distinct = windows(streams, list(range(len(streams))), RUN_TOKENS)
    hit = distinct >= RUN_PAGES
    if shared.num_rows:
        places = _places(begin)
        places = places[~hit[places]]
        pair = np.dtype([("a", np.int64), ("b", np.int64)])
        known = np.rec.fromarrays([shared.column(c).to_numpy() for c in ("a", "b")], dtype=pair)
        names = np.ascontiguousarray(_names(text, places, words)).view(pair).reshape(-1)
        hit[places[np.isin(names, known)]] = True
    return _kept(group, covered(begin, np.flatnonzero(hit), RUN_TOKENS))


def _kept(group: pa.Table, marks: list[np.ndarray]) -> pa.Table:
    own = [k for k, judged in enumerate(group.column("judged").to_pylist()) if judged]
    out = []
    for k in own:
        kept, at = [], 0
        for text, kind in zip(group.column("texts")[k].as_py(), group.column("kinds")[k].as_py(), strict=True):
            words = text.split(" ")
            if kind == STAYS:
                kept.append(text)
            elif kind == OPEN:
                left = [w for w, gone in zip(words, marks[k][at : at + len(words)].tolist(), strict=True) if not gone]
                if left:
                    kept.append(" ".join(left))
            at += len(words)
        out.append("\n".join(kept))
    cols = [group.column("page_id").take(own), group.column("url").take(own), pa.array(out, pa.string())]
    return pa.table(cols, names=["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Tags are evidence: blocks in an article (or main) element stay even if other pages have them too,
    and what tags or class names mark as menu, header, footer, sidebar, notice, advert, form or comment
    goes. On all other blocks the host decides, on pages with an article as well: the token streams of
    all its pages, whole, are laid into suffix arrays, dealt into groups of about GROUP_BYTES, and the
    runs stay that fewer than RUN_PAGES pages of the host have. Where a host has several groups, the
    intervals of their suffix arrays are added up by name over the host. Hosts whose tags leave nothing
    open need no suffix array.

    Null or empty html gives empty text; null ids and urls stay null (no host is a host). Repeated
    rows are pages of their own. Broken markup ends at the end of the page. No rows give no rows.
    Columns other than the three are not carried.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.col(f"`{html}`").alias("html"),
    )
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t))
    blocks = stored(_parsed(rows).withColumns({"host": host_of(F.col("url")), "bytes": size}), "page_blocks")
    stays = F.transform(F.filter(F.arrays_zip("texts", "kinds"), lambda x: x["kinds"] == STAYS), lambda x: x["texts"])
    told = blocks.where("not judged").select("page_id", "url", F.array_join(stays, "\n").alias("text"))
    hosts = stored(
        blocks.groupBy("host")
        .agg(F.ceil((F.sum("bytes") + 1) / GROUP_BYTES).cast("int").alias("groups"), F.bool_or("judged").alias("open"))
        .where("open")
        .select("host", "groups", F.monotonically_increasing_id().alias("host_no")),
        "page_hosts",
    )
    dealt = blocks.join(hosts, "host").withColumn("group", F.pmod(F.xxhash64("row"), F.col("groups")))
    counted = dealt.where("groups > 1").groupBy("host_no", "group").applyInArrow(group_runs, _COUNTED)
    # At most one row per group and name is collected.
    shared = (
        counted.groupBy("host_no", "a", "b")
        .agg(F.sum("pages").alias("pages"), F.collect_list(F.when(F.col("open"), F.col("group"))).alias("in"))
        .where((F.col("pages") >= RUN_PAGES) & (F.size("in") > 0))
        .select("host_no", F.explode("in").alias("group"), "a", "b")
    )
    keys = ["host_no", "group"]
    runs = dealt.groupBy(*keys).cogroup(shared.groupBy(*keys)).applyInArrow(unique_runs, _TEXT)
    return told.unionByName(runs).withColumn("n_chars", F.length("text").cast("long"))
