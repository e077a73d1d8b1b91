"""Main text of pages: repeated runs of a host, found with a suffix array, are boilerplate.

A page is cut into blocks by its markup. Elements that are never part of an article (menus, footers,
forms, scripts and so on) are left out. Every page is then compared with all others of its host: the
token streams of what lies outside marked articles are concatenated, suffixes are sorted by prefix
doubling, and runs of at least `Runs.length` tokens that occur on other pages too are boilerplate of the
host. Blocks mostly covered by such runs are removed, from pages without a mark and from marked articles.

Repeats inside articles alone are no boilerplate: articles are copied, too. And an article may be quoted
outside, by a teaser or a comment. So in marked articles a run counts only if `Runs.pages` streams outside
of articles and as many different articles of the host have it.

Streams and articles of equal content count once. A host of any size is cut into groups of bounded size; the
runs of all groups are summed by host before any is judged, so no repeat across groups is lost.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.session import materialise

GROUP_STREAMS = 256
# Runs of all hosts, 8 bytes each, that are sent to every task to leave out windows that are in none.
MAX_SENT_RUNS = 1_000_000
OUT, OPEN, MAIN, ARTICLE = 0, 1, 2, 3

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:(?:[^>"']++|"[^"]*"|'[^']*')*+(?=>|\Z)|[^>]*))(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
# Elements whose content is no text of the page.
SKIPPED = set("script style noscript template iframe svg math textarea title select button object canvas audio video".split())
ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in SKIPPED}
BLOCKS = set("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CHROME = set("nav footer aside form menu dialog".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Parts of class names and ids that name no article text, wherever they stand.
HINTS = set("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
gdpr menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related
replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split())
# The same outside an article only: an article may have its own header.
OUTER_HINTS = HINTS | set("header footer masthead topbar copyright".split())


@dataclass(frozen=True)
class Runs:
    """A run is boilerplate from `length` tokens (a power of two) on if it occurs in `pages` different streams of a host; a
    block is removed if at least the share `covered` of its tokens lies in such runs."""

    length: int = 8
    pages: int = 3
    covered: float = 0.5

    def __post_init__(self):
        if self.length < 1 or self.length & (self.length - 1):
            raise ValueError("length must be a power of two")


def chrome(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds no article text; `inside`: it lies in an article or main element."""
    if name in CHROME or (name == "header" and not inside):
        return True
    if not attributes:
        return False
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault((m.group(1) or m.group(5)).lower(), m.group(2) or m.group(3) or m.group(4) or "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in CHROME_ROLES and name != "article":
        return True
    if name in ("body", "html", "main"):
        return False
    words = re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower())
    return not (HINTS if inside or name == "article" else OUTER_HINTS).isdisjoint(words)


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order: OUT of any article, OPEN, in MAIN or in an ARTICLE."""
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, int]] = []
    hidden = 0
    zones = [0] * 4

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((OUT if hidden else ARTICLE if zones[ARTICLE] else MAIN if zones[MAIN] else OPEN, text))

    def close(to: int) -> None:
        nonlocal hidden
        for _, was_chrome, zone in stack[to:]:
            hidden -= was_chrome
            zones[zone] -= 1
        del stack[to:]

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in SKIPPED:
            if not m.group(3).endswith("/"):
                end = ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            pieces.append(" ")
        if name in BLOCKS:
            flush()
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name == "li"):
                close(len(stack) - 1)
        if name in VOID or m.group(3).endswith("/") and name not in BLOCKS:
            continue
        away = chrome(name, m.group(3), bool(zones[ARTICLE] or zones[MAIN]))
        if name in BLOCKS or away:
            zone = ARTICLE if name == "article" else MAIN if name == "main" or 'role="main"' in m.group(3) else OPEN
            stack.append((name, away, zone))
            hidden += away
            zones[zone] += 1
    flush()
    return out


def marked_text(found: list[tuple[int, str]]) -> str | None:
    """The text of the article, or else of the main element; None if the page marks neither."""
    for zone in (ARTICLE, MAIN):
        own = [text for z, text in found if z == zone]
        if own:
            return "\n\n".join(own)
    return None


def host_of(url: str | None) -> str:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    _, found, rest = (url or "").partition("://")
    own = re.split(r"[/?#]", rest, maxsplit=1)[0] if found else ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in own)


def article_id(text: str) -> int:
    """The same for articles with the same text."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def texts_of_marked(pages: DataFrame) -> DataFrame:
    """page_id, url, host, sid, text: of pages that mark their article, with the id of its text."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            texts = [marked_text(blocks(h.as_py() or "")) for h in batch.column("html")]
            rows = [i for i, text in enumerate(texts) if text is not None]
            own, kept = batch.take(pa.array(rows, pa.int64())), [texts[i] for i in rows]
            yield pa.record_batch([own.column("page_id"), own.column("url"), pa.array([host_of(u.as_py()) for u in own.column("url")], pa.string()),
                                   pa.array(map(article_id, kept), pa.int64()), pa.array(kept, pa.string())], ["page_id", "url", "host", "sid", "text"])

    return pages.mapInArrow(run, "page_id long, url string, host string, sid long, text string")


STREAM = "host string, stream array<string>, open boolean"


def streams(pages: DataFrame) -> DataFrame:
    """page_id, url, host, stream, open. `stream`: the texts of the blocks outside any marked article. `open`: the
    page marks none, so its stream has to be judged; the blocks left out by markup are then no part of it."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            hosts, lists, opens = [], [], []
            for url, page in zip(batch.column("url"), batch.column("html")):
                found = blocks(page.as_py() or "")
                is_open = marked_text(found) is None
                hosts.append(host_of(url.as_py()))
                lists.append([text for zone, text in found if (zone == OPEN if is_open else zone < MAIN)])
                opens.append(is_open)
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()),
                                   pa.array(lists, pa.list_(pa.string())), pa.array(opens, pa.bool_())],
                                  ["page_id", "url", "host", "stream", "open"])

    return pages.mapInArrow(run, f"page_id long, url string, {STREAM}")


MARK = 0  # stands between the blocks of a stream


def token_hashes(stream: list[str]) -> np.ndarray:
    """64-bit hashes of the words of a stream, with MARK after each block."""
    out: list[int] = []
    for block in stream:
        out += [xxhash.xxh64_intdigest(word) | 1 for word in block.split()]
        out.append(MARK)
    return np.array(out, np.uint64)


def window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` tokens from each place on; the same wherever the same tokens stand."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = total * np.uint64(0x9E3779B97F4A7C15) + (tokens[i : i + n] ^ (tokens[i : i + n] >> np.uint64(29)))
    return (total ^ (total >> np.uint64(31))).view(np.int64)


def suffix_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first `length` tokens, a power of two: suffixes that share them have
    equal rank. Prefix doubling: ranks of twice the length come from pairs of ranks."""
    _, ranks = np.unique(tokens, return_inverse=True)
    done = 1
    while done < length:
        later = np.full(len(ranks), -1, np.int64)
        later[: max(0, len(ranks) - done)] = ranks[done:]
        pair = ranks.astype(np.int64) * (len(ranks) + 1) + later + 1
        _, ranks = np.unique(pair, return_inverse=True)
        done *= 2
    return ranks


def repeated_runs(group: list[list[str]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, streams): each run of `length` tokens in the streams of a group, with the number of streams
    it occurs in. The streams are concatenated; runs across the end of one are no runs."""
    parts = [token_hashes(s) for s in group]
    if not parts or not sum(len(p) for p in parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    hashes = np.zeros(len(tokens), np.int64)
    inside = np.zeros(len(tokens), bool)
    at = 0
    for p in parts:
        own = window_hashes(p, length)
        hashes[at : at + len(own)] = own
        inside[at : at + len(own)] = True
        at += len(p)
    ranks = suffix_ranks(tokens, length)
    order = np.lexsort((owner, ranks))  # the suffix array, streams in order among equal prefixes
    order = order[inside[order]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, own = ranks[order], owner[order]
    first = np.concatenate([[True], rank[1:] != rank[:-1]])
    other = first | np.concatenate([[True], own[1:] != own[:-1]])
    starts = np.flatnonzero(first)
    return hashes[order[starts]], np.add.reduceat(other.astype(np.int64), starts)


def boilerplate(distinct: DataFrame, how: Runs) -> DataFrame:
    """host, run: hashes of the runs that occur in at least `how.pages` streams of a host."""
    sizes = distinct.groupBy("host").agg(F.count("*").alias("n"))
    grouped = distinct.join(sizes, "host").withColumn("part", F.pmod(F.col("sid"), F.ceil(F.col("n") / GROUP_STREAMS)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, counts = repeated_runs(table["stream"].to_pylist(), how.length)
        host = pa.array([key[0].as_py()] * len(found), pa.string())
        return pa.table({"host": host, "run": pa.array(found, pa.int64()), "streams": pa.array(counts, pa.int64())})

    runs = grouped.select("host", "part", "stream").groupBy("host", "part").applyInArrow(run, "host string, run long, streams long")
    return runs.groupBy("host", "run").agg(F.sum("streams").alias("streams")).filter(F.col("streams") >= how.pages).select("host", "run")


def judged(distinct: DataFrame, runs: DataFrame, how: Runs) -> DataFrame:
    """host, sid, text of the open streams: their blocks that repeated runs do not cover."""
    own = distinct.filter("open").select("host", "sid", "stream")

    def windows(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                found = window_hashes(token_hashes(batch.column("stream")[i].as_py()), how.length)
                yield window_rows(batch.column("host")[i].as_py(), batch.column("sid")[i].as_py(), np.arange(len(found)), found)

    places = own.mapInArrow(windows, WINDOW).join(runs, ["host", "run"], "left_semi")
    places = places.groupBy("host", "sid").agg(F.collect_list("place").alias("places"))  # at most the places of one page
    joined = own.join(places, ["host", "sid"], "left")

    def texts(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            kept = [kept_text(s.as_py(), p.as_py() or [], how) for s, p in zip(batch.column("stream"), batch.column("places"))]
            yield pa.record_batch([batch.column("host"), batch.column("sid"), pa.array(kept, pa.string())], ["host", "sid", "judged"])

    return joined.mapInArrow(texts, "host string, sid long, judged string")


WINDOW = "host string, sid long, place long, run long"


def window_rows(host: str, sid: int, places: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([host] * len(found), pa.string()), pa.array([sid] * len(found), pa.int64()),
                            pa.array(places, pa.int64()), pa.array(found, pa.int64())], ["host", "sid", "place", "run"])


def article_places(rows: DataFrame, runs: DataFrame, how: Runs) -> DataFrame:
    """host, sid, places: where the host's boilerplate stands in its marked articles. Of all windows of the articles only those
    in `runs` leave a task, where these are few enough to be sent; else the join finds them."""
    sent = runs.limit(MAX_SENT_RUNS + 1).toArrow()
    by_host: dict[str, np.ndarray] | None = None
    if sent.num_rows <= MAX_SENT_RUNS:
        lists = sent.group_by("host").aggregate([("run", "list")])
        by_host = {host.as_py(): np.sort(own.values.to_numpy()) for host, own in zip(lists.column("host"), lists.column("run_list"))}
    shared = runs.sparkSession.sparkContext.broadcast(by_host)

    def windows(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for url, page in zip(batch.column("url"), batch.column("html")):
                host = host_of(url.as_py())
                if shared.value is not None and host not in shared.value:
                    continue
                text = marked_text(blocks(page.as_py() or ""))
                if text is not None:
                    found = window_hashes(token_hashes(text.split("\n\n")), how.length)
                    places = np.arange(len(found)) if shared.value is None else np.flatnonzero(np.isin(found, shared.value[host]))
                    if len(places):
                        yield window_rows(host, article_id(text), places, found[places])

    hits = materialise(rows.select("url", "html").mapInArrow(windows, WINDOW).join(runs, ["host", "run"], "left_semi").distinct())
    inside = hits.groupBy("host", "run").agg(F.count_distinct("sid").alias("n")).filter(F.col("n") >= how.pages)
    own = hits.join(inside, ["host", "run"], "left_semi")
    return own.groupBy("host", "sid").agg(F.collect_list("place").alias("places"))  # at most the places of one page


def judged_articles(marked: DataFrame, places: DataFrame, how: Runs) -> DataFrame:
    """page_id, url, text of marked pages: the blocks of the article that the boilerplate at `places` does not cover."""

    @F.arrow_udf("string")
    def kept(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in columns:
            rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            if len(rows):
                changed = texts.to_pylist()
                for i in rows:
                    changed[i] = kept_text(changed[i].split("\n\n"), lists[int(i)].as_py(), how)
                texts = pa.array(changed, pa.string())
            yield texts

    return marked.join(places, ["host", "sid"], "left").select("page_id", "url", kept("text", "places").alias("text"))


def kept_text(stream: list[str], places: list[int], how: Runs) -> str:
    """The blocks of which less than the share `how.covered` lies in the runs that start at `places`."""
    sizes = [len(block.split()) for block in stream]
    covered = np.zeros(sum(sizes) + len(sizes) + how.length + 1, np.int64)
    np.add.at(covered, np.array(places, np.int64), 1)
    np.add.at(covered, np.array(places, np.int64) + how.length, -1)
    inside = np.cumsum(covered) > 0
    out, at = [], 0
    for block, size in zip(stream, sizes):
        if inside[at : at + size].sum() < how.covered * size:
            out.append(block)
        at += size + 1
    return "\n\n".join(out)


def main_text(pages: DataFrame, how: Runs = Runs(), row_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text for every row.

    The blocks of the main text in page order, white space inside a block as one space, joined by a blank
    line; empty if there is none, also for a null or empty page. A null url or one without :// belongs to
    the host "". Repeated rows and rows with a null id stay; an empty table gives an empty result. Other
    columns are ignored.
    """
    rows = pages.select(F.col(row_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    found = materialise(streams(rows).withColumn("sid", F.xxhash64("stream", "open")))
    distinct = materialise(found.select("host", "sid", "stream", "open").dropDuplicates(["host", "sid"]))
    runs = materialise(boilerplate(distinct, how))
    answers = judged(distinct, runs, how)
    marked = judged_articles(texts_of_marked(rows), materialise(article_places(rows, runs, how)), how)
    unmarked = found.filter("open").select("page_id", "url", "host", "sid").join(answers, ["host", "sid"])
    return marked.unionByName(unmarked.select("page_id", "url", F.col("judged").alias("text")))
