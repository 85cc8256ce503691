"""Main text of web pages: page structure, and the token runs that repeat on other pages of a host.

Blocks inside an article or main element belong to the text, blocks of menus, adverts,
forms and the like do not. Blocks that structure doesn't decide are dropped where long
token runs that cover them repeat on other pages of the same host; near-equal pages of
a host count as one page for that.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import small_batches, small_side, written
from eventloom.llm.components import components

#: Parameters: tokens of a repeated run, share of a block's tokens that must lie in such runs.
MIN_RUN = 8
COVERED = 0.8
#: Tokens hashed at a time; a bound on memory without bearing on results.
ARRAY_TOKENS = 20_000
#: Near-equal pages share one of so many bands of so many least hashes of runs: at 0.95 of all runs in common nearly always, at half hardly ever.
BANDS, BAND_ROWS = 8, 8

#: What tags and class or id words say about an element.
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas datalist".split())
HEAD_PARTS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
ASIDE = frozenset("nav footer aside form button select textarea dialog menu".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out: those that one's start ends, and the elements that it doesn't reach out of.
ENDED_BY = {
    **dict.fromkeys(["li"], (("li",), ("ul", "ol", "menu"))),
    **dict.fromkeys(["dt", "dd"], (("dt", "dd"), ("dl",))),
    **dict.fromkeys(["td", "th"], (("td", "th"), ("table",))),
    **dict.fromkeys(["tr"], (("td", "th", "tr"), ("table",))),
    **dict.fromkeys(["thead", "tbody", "tfoot"], (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",))),
    **dict.fromkeys(["option", "optgroup"], (("option",), ("select", "datalist"))),
}
P_SCOPE = ("button", "caption", "object", "select", "table", "td", "th")
#: Class and id words of what isn't text, whatever stands beside them; of what isn't unless a wrapper's word does; of readers' words inside an article.
ALWAYS_SIDE = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus newsletter popup promo related remark reply replies respond share sharing signup social sponsor sponsored subscribe teaser teasers".split())
SIDE_WORDS = ALWAYS_SIDE | frozenset("footer login masthead menu modal nav navbar navigation notice notices pagination recommended sidebar toolbar widget".split())
READER_WORDS, READERS = frozenset("feedback review reviews testimonial testimonials".split()), frozenset("customer customers reader readers user users visitor visitors".split())
FLAG_WORDS = frozenset("has no with without".split())
WRAPPER_WORDS = frozenset("article body container content has layout main no page post story text with without wrap wrapper".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
PLACES = np.frombuffer(b"".join(hashlib.blake2b(b"%d" % k, digest_size=16).digest() for k in range(MIN_RUN)), np.uint64).reshape(MIN_RUN, 2) | np.uint64(1)
UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
OUT, IN, OPEN = 0, 1, 2  # what structure says of a block: not text, text, undecided


class _Blocks(HTMLParser):
    """Collects a page's blocks as (text, verdict); white space within a block is one space.

    A piece of text is judged where it stands, so a button or an advert inside a paragraph
    leaves the rest of it alone; such pieces make a block of their own. End tags that HTML
    lets out are implied. A tag costs a fixed number of steps, however many elements are open.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int]] = []
        self.open: list[tuple[str, int | None]] = []  # tag, and the verdict on text inside
        self.depth: Counter[str] = Counter()  # open elements by tag
        self.scopes: dict[str, list[int]] = {}  # for open elements that may be ended by others: how many scopes were open when they began
        self.text: list[tuple[str, int | None]] = []
        self.seen_main = False

    def verdict(self) -> int | None:
        """Hidden (None), OUT, IN or OPEN for text at this place."""
        return self.open[-1][1] if self.open else OPEN

    def scope(self, tag: str) -> int:
        """How many elements are open that an element of this kind doesn't reach out of."""
        return sum(self.depth[t] for t in (P_SCOPE if tag == "p" else ENDED_BY[tag][1]))

    def push(self, tag: str, says: int | None) -> None:
        """Open an element; what is hidden or out stays so inside, and what is in unless it says otherwise."""
        around = self.verdict()
        inside = None if None in (around, says) else OUT if OUT in (around, says) else IN if IN in (around, says) else OPEN
        if tag == "p" or tag in ENDED_BY:
            self.scopes.setdefault(tag, []).append(self.scope(tag))
        self.open.append((tag, inside))
        self.depth[tag] += 1
        self.seen_main |= inside == IN

    def pop(self) -> str:
        tag, _ = self.open.pop()
        self.depth[tag] -= 1
        if tag in self.scopes:
            self.scopes[tag].pop()
        return tag

    def flush(self) -> None:
        """End a block: what is text or undecided, and what is not, which stays apart."""
        for out in (False, True):
            some = [(t, v) for t, v in self.text if (v == OUT) == out]
            text = " ".join("".join(t for t, _ in some).split())
            if text:
                self.blocks.append((text, OUT if out else IN if any(v == IN and t.strip() for t, v in some) else OPEN))
        self.text = []

    def says(self, tag: str, attrs: list[tuple[str, str | None]]) -> int | None:
        named = dict(attrs)
        if tag in HIDDEN or UNSEEN.search(named.get("style") or ""):
            return None
        if tag in ASIDE:
            return OUT
        role = (named.get("role") or "").lower()
        names = [re.split(r"[^a-z0-9]+", name) for name in f"{named.get('class') or ''} {named.get('id') or ''}".lower().split()]
        words = {w for name in names for w in name}
        # what follows a flag, as in has-comments, is said of the element's surroundings or parts
        own = {w for name in names for k, w in enumerate(name) if not FLAG_WORDS & set(name[:k])}
        side = bool(own & ALWAYS_SIDE) or bool(words & SIDE_WORDS) and not words & WRAPPER_WORDS
        # an article may be a review; inside another one, or by a reader, it is a comment
        side |= bool(own & READER_WORDS) and bool(self.depth["article"] or own & READERS)
        if tag not in ("html", "body") and (side or role in ROLES or "hidden" in named):
            return OUT
        if tag in MAIN or role in ("main", "article"):
            return IN
        return OUT if tag == "header" and self.verdict() != IN else OPEN

    def handle_starttag(self, tag, attrs):
        if self.open and self.open[-1][0] == "head" and tag not in HEAD_PARTS:
            self.close_to("head")
        if tag in ("br", "option", "optgroup"):
            self.text.append((" ", self.verdict()))
        if tag in BLOCKS:
            self.flush()
            if tag not in ("html", "body"):
                self.end("p")
        for other in ENDED_BY[tag][0] if tag in ENDED_BY else ():
            self.end(other)
        if tag not in VOID:
            self.push(tag, self.says(tag, attrs))

    def handle_endtag(self, tag):
        if tag in BLOCKS and (self.depth[tag] or tag == "p"):  # one that ends nothing is left out
            self.flush()
        self.close_to(tag)

    def end(self, tag: str) -> None:
        """Close an open element of a kind unless it lies outside of the scope."""
        if self.depth[tag] and self.scopes[tag][-1] == self.scope(tag):
            self.close_to(tag)

    def close_to(self, tag: str) -> None:
        if self.depth[tag]:
            while self.pop() != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.close_to("head")
        if self.verdict() is not None:
            self.text.append((data, self.verdict()))


def page_blocks(html: str) -> list[tuple[str, int]]:
    """The blocks of a page in order, each with OUT, IN or OPEN; where a page has main text, nothing is undecided."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [(t, OUT if v is None or v == OPEN and parser.seen_main else v) for t, v in parser.blocks]


def repeated_places(tokens: np.ndarray, page: np.ndarray, run: int = MIN_RUN) -> np.ndarray:
    """Which tokens lie in a run of `run` tokens or more that a distinct page has too, by a suffix array: the pages of one host on one machine.

    tokens holds the pages' streams one after the other, page the page of each token. The
    suffixes are ranked by prefix doubling until `run` tokens count; suffixes of equal
    rank are neighbours in the suffix array, and longer repeats are runs that overlap.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < run:
        return covered
    _, rank = np.unique(tokens, return_inverse=True)
    rank, length = rank.astype(np.int64), 1
    while length < run:
        step = min(length, run - length)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        order = np.lexsort((ahead, rank))
        new = np.r_[True, (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        length += step
    whole = np.zeros(n, bool)
    whole[: n - run + 1] = page[: n - run + 1] == page[run - 1 :]
    array = np.lexsort((page, rank))
    array = array[whole[array]]
    starts = np.flatnonzero(np.r_[True, rank[array][1:] != rank[array][:-1]]) if len(array) else np.zeros(0, int)
    ends = np.append(starts[1:], len(array)) - 1
    shared = np.repeat(page[array[starts]] != page[array[ends]], ends - starts + 1) if len(array) else np.zeros(0, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, array[shared], 1)
    np.add.at(edge, array[shared] + run, -1)
    return np.cumsum(edge[:-1]) > 0


def _word_hashes(words: list[str], person: bytes) -> np.ndarray:
    digests = b"".join(hashlib.blake2b(w.encode(errors="surrogatepass"), digest_size=16, person=person).digest() for w in words)
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


def window_keys(tokens: list[str], page: np.ndarray, hosts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of MIN_RUN tokens within a page start, and each one's key of 128 bits, which is equal for equal runs of a host.

    tokens holds the pages' streams one after the other, page the number of each token's page, hosts the host by that number.
    """
    n = len(tokens) - MIN_RUN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    code, distinct = pd.factorize(np.array(tokens, object))
    hashes, keys = _word_hashes(list(distinct), b"word"), _word_hashes(hosts, b"host")[page[:n]]
    for k in range(MIN_RUN):
        keys = keys + hashes[code[k : k + n]] * PLACES[k]
    starts = np.flatnonzero(page[:n] == page[MIN_RUN - 1 :])
    return starts, keys[starts]


def band_keys(keys: np.ndarray) -> np.ndarray:
    """A page's bands, given the keys of its runs: near-equal pages have one in common."""
    one = np.unique(keys[:, 0] ^ keys[:, 1])
    least = np.empty(BANDS * BAND_ROWS, np.uint64)
    for k in range(len(least)):
        x = (one ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        least[k] = (x ^ (x >> np.uint64(31))).min()
    odd = np.arange(1, BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
    return (least.reshape(BANDS, BAND_ROWS) * odd).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)


def _windows(pages: list[tuple[int, str, list[dict]]]) -> pa.RecordBatch:
    """The runs of MIN_RUN tokens outside the pages' main text: row, place in the page's stream, key, whether an undecided block has a part in it."""
    tokens, sizes, is_open = [], [], []
    for _, _, blocks in pages:
        before = len(tokens)
        for b in blocks:
            if b["says"] != IN:
                own = b["text"].split()
                tokens += own
                is_open += [b["says"] == OPEN] * len(own)
        sizes.append(len(tokens) - before)
    starts, keys = window_keys(tokens, np.repeat(np.arange(len(pages)), sizes), [host for _, host, _ in pages])
    seen = np.concatenate([[0], np.cumsum(np.array(is_open, bool))])
    rows, firsts = np.repeat([row for row, _, _ in pages], sizes).astype(np.int64), np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int64)
    columns = [pa.array(rows[starts]), pa.array((starts - firsts[starts]).astype(np.int32)), *(pa.array(keys[:, k].astype(np.int64)) for k in (0, 1)), pa.array(seen[starts + MIN_RUN] > seen[starts])]
    return pa.RecordBatch.from_arrays(columns, names=["row", "place", "key", "key2", "open"])


def gone_blocks(sizes: list[int], says: list[int], places: list[int]) -> list[int]:
    """The undecided blocks of a page that go, given its blocks' tokens and where repeated runs start in its stream.

    Where all undecided text lies in such runs, none of it goes: something has to be the page's text.
    """
    ends = np.cumsum([n if s != IN else 0 for n, s in zip(sizes, says)])
    edge = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.array(places) + MIN_RUN, -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    undecided = [(k, n, sums[end] - sums[end - n]) for k, (n, s, end) in enumerate(zip(sizes, says, ends)) if s == OPEN]
    all_of_it = sum(hit for _, _, hit in undecided) == sum(n for _, n, _ in undecided)
    return [] if all_of_it else [k for k, n, hit in undecided if hit >= COVERED * n]


def _in_parts(batches: Iterator[pa.RecordBatch], array_tokens: int) -> Iterator[list[tuple]]:
    """Pages (row, host, blocks) in groups of about array_tokens tokens."""
    for batch in batches:
        some, size = [], 0
        for page in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "blocks"))):
            some.append(page)
            size += sum(b["n"] for b in page[2])
            if size >= array_tokens:
                yield some
                some, size = [], 0
        if some:
            yield some


def families(pages: DataFrame, array_tokens: int = ARRAY_TOKENS) -> DataFrame:
    """Near-equal pages of a host: row, family (the least row of those that are connected by shared bands); only pages that have company.

    Each page meets the first of its band, by one partial minimum and one join a band, so
    a page with any number of copies costs no more than another.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _in_parts(batches, array_tokens):
            rows, found = [], []
            for row, host, blocks in some:
                tokens = [t for b in blocks if b["says"] != IN for t in b["text"].split()]
                _, keys = window_keys(tokens, np.zeros(len(tokens), np.int64), [host])
                if len(keys):
                    rows += [row] * BANDS
                    found.append(band_keys(keys).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["row", "band"])

    of_band = written(pages.select("row", "host", "blocks").mapInArrow(bands, "row long, band long"), "pages-bands")
    first = of_band.groupBy("band").agg(F.min("row").alias("b"), F.count("*").alias("n")).filter("n > 1").select("band", "b")
    edges = of_band.join(first, "band").filter("row <> b").select(F.col("row").alias("a"), "b").distinct()
    return components(edges, "pages-families").select(F.col("node").alias("row"), F.col("component").alias("family"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", array_tokens: int = ARRAY_TOKENS) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by a line feed), n_chars (long).

    Runs of MIN_RUN tokens outside the main text are dealt by (host, run), so equal runs
    meet on a host of any size, and a key gathers the first and last page of each task
    only. A run repeats if it lies on two pages of the host that aren't near-equal (see
    families(); pages whose structure decides all are not compared). Hosts without an
    undecided block are left out, as nothing depends on their runs. array_tokens bounds
    the tokens hashed at a time and has no bearing on results. An undecided block goes if
    repeated runs cover COVERED of it, unless they cover all undecided text of the page.

    Null html counts as empty and gives an empty text; null or odd urls share a host of
    their own; repeated rows give equal rows (they are copies of each other); an empty
    table gives an empty result; other columns are not read.
    """
    small_batches(pages.sparkSession, 500)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("says", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            found = [[{"text": t, "says": v, "n": 0 if v == IN else len(t.split())} for t, v in page_blocks(html)] for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, kind)], names=["page_id", "url", "blocks"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    types = dict(rows.dtypes)
    parsed = rows.mapInArrow(parse, f"page_id {types['page_id']}, url {types['url']}, blocks array<struct<text:string,says:int,n:int>>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    parsed = written(parsed.withColumns({"row": F.monotonically_increasing_id(), "host": host, "undecided": F.exists("blocks", lambda b: b["says"] == OPEN)}), "pages-parsed")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_windows, _in_parts(batches, array_tokens))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gone_blocks(*page) for page in zip(*(batch.column(c).to_pylist() for c in ("n", "says", "places")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int32()))], names=["row", "gone"])

    kept = lambda gone: F.filter("blocks", lambda b, i: (b["says"] == IN) | ((b["says"] == OPEN) & ~gone(i)))
    joined = lambda blocks: F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
    undecided = parsed.filter("undecided")
    if undecided.isEmpty():
        out = parsed.withColumn("text", joined(kept(lambda i: F.lit(False))))
    else:
        hosts = small_side(written(undecided.select("host").distinct(), "pages-hosts"))
        runs = parsed.join(hosts, "host", "left_semi").select("row", "host", "blocks").mapInArrow(windows, "row long, place int, key long, key2 long, open boolean")
        of_family = runs.join(small_side(written(families(undecided, array_tokens), "pages-family")), "row", "left").withColumn("page", F.coalesce("family", "row"))
        shared = of_family.groupBy("key", "key2").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.max("open").alias("open"))
        shared = small_side(written(shared.filter("open AND first < last").select("key", "key2"), "pages-runs"))
        places = runs.filter("open").join(shared, ["key", "key2"]).groupBy("row").agg(F.collect_list("place").alias("places"))
        sizes = undecided.select("row", F.col("blocks.n").alias("n"), F.col("blocks.says").alias("says"))
        gone = sizes.join(places, "row").select("row", "n", "says", "places").mapInArrow(judge, "row long, gone array<int>")
        gone = small_side(written(gone.filter(F.size("gone") > 0), "pages-gone"))
        out = parsed.join(gone, "row", "left").withColumn("text", joined(kept(lambda i: F.coalesce(F.array_contains("gone", i), F.lit(False)))))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
