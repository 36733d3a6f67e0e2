"""Main text of web pages, with a host suffix array for boilerplate.

Each page is parsed into text blocks, each with its place: ``main`` (inside an article or main element), ``out``
(menus, headers and footers of the page, sidebars, adverts, forms, notices, comments, by element, role or
class name) or ``open`` (neither; these count only on pages without a main block).  Hosts with open pages are dealt into shards of
about ``shard_bytes`` of text by page hash, so no group grows with the host.  In a shard the pages' token streams are
concatenated, and a suffix array, sorted to a depth of ``run_tokens`` tokens by prefix doubling, lists the distinct token runs of that
length with the pages that hold them.  These lists are counted by host and run hash over all shards: a run on ``min_pages`` and on
``min_share`` of the host's distinct pages is boilerplate, whatever the shards, and the host's boilerplate runs go back to each of its
shards (a run takes that share of the pages, so there are at most 1 / ``min_share`` times as many as a page has words).
The tokens they cover leave ``open`` blocks; the rest stays.  ``out`` blocks only feed the counts.

A ``main`` block is kept or left whole, for lines recur in articles too: it is boilerplate if it stands on ``min_pages`` and on more
than half of the host's distinct marked pages (those that differ in their main blocks).  Suffix arrays over shards of these pages nominate
the blocks all of whose token runs, from their first to their last word, stand on more than half of a shard's pages; whatever
more than half of the host's pages hold is so in one shard at least.  The nominated blocks are then counted over the whole host.  A page
that would lose more than half of its main text so is a copy of others, not an article with boilerplate, and keeps all of it.

Pages with equal open blocks (with main blocks: equal main blocks; with neither: equal blocks) count as one page, so copies that
differ in an advert or footer do not cover each other.
Defined results: null or empty html gives an empty text; an unreadable url is a host of its own (""); repeated
rows are extracted each; broken markup is read as far as it goes, an unclosed tag ends the text.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcred.llm.common import runs, sent, span_hashes, stored, utf8

RUN_TOKENS, MIN_PAGES, MIN_SHARE, SHARD_BYTES = 6, 3, 0.01, 4 << 20
#: Characters of pages that a task packs together before they move.
PACK_CHARS = 16 << 20

#: Elements whose text is never shown, and elements that are not the article wherever they stand.
SILENT = frozenset("script style noscript template svg math head title iframe object canvas select option textarea audio video".split())
ASIDE = frozenset("nav aside form footer dialog button menu fieldset label input".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
                   "time tt u var wbr img br label input".split())
#: Elements that end an open paragraph or item of their kind.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
          "th": {"td", "th", "p"}}
#: Class names, ids and roles that mark a container as not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
                  "footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
                  "popup promo promoted related reply replies responses search share sharing sidebar signup skip social sponsor sponsored "
                  "subscribe subscription toolbar topbar widget contentinfo complementary".split())

#: Words that name the article's own container, and marks that mean nothing inside it (an article's header holds its headline).
MAIN_MARKS = frozenset("article articlebody post postbody entry story".split())
INSIDE = frozenset(("header", "banner"))

#: Words that may stand beside a mark in a name without saying what the container holds.
NEUTRAL = frozenset("area article bar block body bottom box button buttons col column container content count entry first form global group "
                    "holder icons inline inner item items last left link links list main module outer page panel post posts primary region "
                    "right row secondary section site slot strip thread title top unit widgets wrap wrapper zone".split())

# Attributes by position: a name, and a quoted or an unquoted value, which may hold quotes.
_VALUE = r"""\s*+=\s*+(?>"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|)"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[\s/]++|=?[^\s/>=]++(?:{_VALUE})?+|=)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*)|))?""")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """Words of each class name, id and role."""
    return [[w.lower() for w in _SPLIT.split(name) if w] for k in ("class", "id", "role") for name in attributes.get(k, "").split()]


def _marked(words: list[str], marks: frozenset[str]) -> bool:
    """A name is a mark as a whole: it has a mark, and its other words are marks, numbers or say nothing."""
    return any(w in marks for w in words) and all(w in marks or w in NEUTRAL or w.isdigit() for w in words)


def _hidden(attributes: dict[str, str]) -> bool:
    return ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I) is not None)


def _aside(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in ASIDE or (tag == "header" and not in_main) or _hidden(attributes):
        return True
    if not attributes or tag in ("html", "body") or tag in MAIN:
        return False
    marks = MARKS - INSIDE if in_main else MARKS
    return any(_marked(words, marks) for words in _names(attributes))


def _main(tag: str, attributes: dict[str, str]) -> bool:
    if tag in MAIN:
        return True
    return tag in ("div", "section", "td") and (any(w in MAIN_MARKS for words in _names(attributes) for w in words)
                                                or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody")


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(place, text) of the page's blocks, in page order; place is main, open or out."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements and what they make of their text: silent, out, main or ""
    text: list[str] = []
    place = "open"

    def flush():
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            if t and place != "silent":
                out.append((place, t))
            text.clear()

    def where() -> str:
        kinds = {k for _, k in stack}
        return "silent" if "silent" in kinds else "out" if "out" in kinds else "main" if "main" in kinds else "open"

    def close(at: int):
        nonlocal place
        flush_needed = any(t not in INLINE or k for t, k in stack[at:])
        if flush_needed:
            flush()
        del stack[at:]
        if flush_needed:
            place = where()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in ("br", "wbr", "img"):
            text.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends where a block begins
                if stack[i][0] in CLOSES.get(tag, ("p",)):
                    close(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in ("p",):
                    break
            flush()
        if tag in VOID or m[3].endswith("/"):
            continue
        attributes = _attributes(m[3]) if m[3] else {}
        kind = ("silent" if tag in SILENT else "out" if _aside(tag, attributes, any(k == "main" for _, k in stack))
                else "main" if _main(tag, attributes) else "")
        if kind:
            flush()
        stack.append((tag, kind))
        if kind:
            place = where()
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            stop = end.start() if end else n
            if tag == "textarea":
                text.append(page[at:stop])
            at = stop
    flush()
    return out


def sorted_runs(tokens: np.ndarray, page: np.ndarray, run_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``run_tokens`` tokens, in suffix order, equal ones by page; which of them begin a new run.

    ``tokens`` are non-negative numbers; ``page`` does not fall.  Ranks of doubling prefixes, as in suffix array building,
    are sorted up to the wanted depth; runs do not cross pages.
    """
    n = len(tokens)
    if n < run_tokens or run_tokens < 1:
        return np.empty(0, np.int64), np.empty(0, bool)
    rank, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while depth < run_tokens:
        step = min(depth, run_tokens - depth)
        after = np.full(n, -1, np.int64)
        after[:n - step] = rank[step:]
        both = (rank << np.int64(32)) + (after + 1)
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        depth += step
    at = np.flatnonzero(page[:n - run_tokens + 1] == page[run_tokens - 1:])
    order = at[np.lexsort((page[at], rank[at]))]
    r = rank[order]
    return order, np.concatenate([[True], r[1:] != r[:-1]])[:len(r)]


def covered_by(starts: np.ndarray, run_tokens: int, n: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a run that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run_tokens, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_runs(tokens: np.ndarray, page: np.ndarray, run_tokens: int, min_pages: int) -> np.ndarray:
    """Which tokens lie in a run of ``run_tokens`` tokens that occurs on ``min_pages`` distinct pages."""
    order, new_run = sorted_runs(tokens, page, run_tokens)
    p = page[order]
    new_page = new_run | np.concatenate([[True], p[1:] != p[:-1]])[:len(p)]
    group = np.cumsum(new_run) - 1
    pages = np.bincount(group, weights=new_page)
    return covered_by(order[pages[group] >= min_pages], run_tokens, len(tokens))


def page_words(parsed: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the pages' joined blocks; starts, ends and page numbers of their words."""
    data, offs = utf8(pa.array([" ".join(t for _, t in blocks) for blocks in parsed], pa.large_string()))
    starts, ends = runs(data != 32, offs)
    return data, starts, ends, np.searchsorted(offs, starts, side="right") - 1


def shard_runs(parsed: list[list[tuple[str, str]]], content: np.ndarray, run_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a run's hash and the content number of a page that holds it."""
    data, starts, ends, page = page_words(parsed)
    order, new_run = sorted_runs(np.unique(span_hashes(data, starts, ends), return_inverse=True)[1], page, run_tokens)
    first = order[new_run]
    hashes = span_hashes(data, starts[first], ends[first + run_tokens - 1]).view(np.int64)
    group, held = np.cumsum(new_run) - 1, content[page[order]]
    by = np.lexsort((held, group))
    group, held = group[by], held[by]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (held[1:] != held[:-1])])[:len(group)]
    return hashes[group[new]], held[new]


def uncommon_texts(parsed: list[list[tuple[str, str]]], common: np.ndarray, run_tokens: int) -> list[str]:
    """Texts of the pages' open blocks without the words in runs whose hashes are in ``common``."""
    data, starts, ends, page = page_words(parsed)
    n = len(starts)
    at = np.flatnonzero(page[:max(0, n - run_tokens + 1)] == page[run_tokens - 1:])
    hit = at[np.isin(span_hashes(data, starts[at], ends[at + run_tokens - 1]).view(np.int64), common)]
    covered, k, out = covered_by(hit, run_tokens, n), 0, []
    for blocks in parsed:
        kept = []
        for place, text in blocks:
            words = text.split(" ")
            if place == "open":
                kept.append(" ".join(w for w, c in zip(words, covered[k:k + len(words)]) if not c))
            k += len(words)
        out.append("\n\n".join(t for t in kept if t))
    return out


def shard_texts(pages: list[str], run_tokens: int, min_pages: int) -> list[str]:
    """Texts of the pages of a host in one shard, main blocks whole."""
    parsed = [blocks_of(p) for p in pages]
    main = ["\n\n".join(t for place, t in blocks if place == "main") for blocks in parsed]
    number: dict = {}
    key = [m or tuple(t for place, t in blocks if place == "open") or tuple(blocks) for m, blocks in zip(main, parsed)]
    hashes, _ = shard_runs(parsed, np.array([number.setdefault(k, len(number)) for k in key], np.int64), run_tokens)
    run, n = np.unique(hashes, return_counts=True)
    return [m or t for m, t in zip(main, uncommon_texts(parsed, run[n >= min_pages], run_tokens))]


BLOCKS = pa.list_(pa.struct([("place", pa.string()), ("text", pa.string())]))


def parsed_pages(rows: DataFrame) -> DataFrame:
    """(page_id, url, h, blocks) of (page_id, url, h, html): each page is parsed once, where it is read."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                blocks = [[{"place": p, "text": t} for p, t in blocks_of(x)] for x in some.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(blocks, BLOCKS)], ["page_id", "url", "h", "blocks"])
    return rows.mapInArrow(run, "page_id long, url string, h long, blocks array<struct<place: string, text: string>>")


def _texts(place: str) -> Column:
    return F.transform(F.filter("blocks", lambda b: b["place"] == place), lambda b: b["text"])


def recurring_blocks(pages: list[list[str]], run_tokens: int) -> list[list[bool]]:
    """Which blocks of the pages (all distinct) have only token runs that stand on more than half of the pages.

    A block has a mark before its first word and ``run_tokens`` - 1 behind its last one, so its runs tell where it begins and ends, and a
    block of fewer words is one run.
    """
    tail = " \1" * (run_tokens - 1)
    joined = pa.array([" ".join(f"\0 {t}{tail}" for t in blocks) for blocks in pages], pa.large_string())
    words = pc.split_pattern(joined, " ")
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    page = np.repeat(np.arange(len(pages)), sizes)
    order, new_run = sorted_runs(words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), page, run_tokens)
    p = page[order]
    group = np.cumsum(new_run) - 1
    held = np.bincount(group, weights=new_run | np.concatenate([[True], p[1:] != p[:-1]])[:len(p)])
    hit = np.zeros(len(page) + 1, np.int64)
    hit[order[2 * held[group] > len(pages)] + 1] = 1
    hits, at, out = np.cumsum(hit), np.cumsum(sizes) - sizes, []
    for start, blocks in zip(at.tolist(), pages):
        out.append([])
        for t in blocks:
            n = t.count(" ") + 2  # runs that begin at the mark or a word
            out[-1].append(bool(hits[start + n] - hits[start] == n))
            start += n + run_tokens - 1
    return out


def packed_pages(batches):
    """(h, shard, contents, size, data) of (h, shard, content, main): the distinct pages that a task has of a shard, their blocks compressed together.

    Blocks hold no line ends and no separators (white space inside them is one space), so these part blocks and pages.
    """
    seen: set[tuple[int, int]] = set()
    held: dict[tuple[int, int], list[tuple[int, str]]] = {}
    size = 0
    for b in batches:
        for h, shard, content, main in zip(*[c.to_pylist() for c in b.columns]):
            if (h, content) not in seen:
                seen.add((h, content))
                held.setdefault((h, shard), []).append((content, "\n".join(main)))
                size += len(held[h, shard][-1][1])
        if size >= PACK_CHARS:
            yield _packs(held)
            held, size = {}, 0
    if held:
        yield _packs(held)


def _packs(held: dict[tuple[int, int], list[tuple[int, str]]]) -> pa.RecordBatch:
    texts = ["\x1c".join(t for _, t in pages).encode() for pages in held.values()]
    return pa.RecordBatch.from_arrays([
        pa.array([h for h, _ in held], pa.int64()), pa.array([s for _, s in held], pa.int64()),
        pa.array([[c for c, _ in pages] for pages in held.values()], pa.list_(pa.int64())), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())], ["h", "shard", "contents", "size", "data"])


def unpacked_pages(table: pa.Table) -> list[list[str]]:
    """The main blocks of a shard's pages, each page once."""
    pages: dict[int, str] = {}
    for contents, size, data in zip(*[table.column(c).to_pylist() for c in ("contents", "size", "data")]):
        text = pa.decompress(data, size, "zstd", asbytes=True).decode() if size else ""
        pages.update(zip(contents, text.split("\x1c")))
    return [pages[c].split("\n") for c in sorted(pages)]


def nominated_blocks(marked: DataFrame, run_tokens: int, min_pages: int, shard_bytes: int) -> DataFrame:
    """(n_h, n_block): the host and hash of every main block that recurs in a shard of the host's distinct pages.

    A page's shard follows from its content, so copies meet in their shard: texts move once, packed, and each task sends a copy once.
    """
    size = F.aggregate("main", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))
    pages = marked.groupBy("h", "content").agg(F.max(size).alias("bytes"))
    hosts = pages.groupBy(F.col("h").alias("m_h")).agg(F.ceil(F.sum("bytes") / shard_bytes).alias("shards"), F.count(F.lit(1)).alias("pages"))
    hosts = stored(hosts.where(F.col("pages") >= min_pages).select("m_h", "shards"), "html-marked")
    dealt = marked.join(sent(hosts), F.col("h") == F.col("m_h"))
    dealt = dealt.select("h", F.pmod(F.xxhash64("content"), "shards").alias("shard"), "content", "main")
    packs = dealt.mapInArrow(packed_pages, "h long, shard long, contents array<long>, size long, data binary").repartition("h", "shard")

    def run(table: pa.Table) -> pa.Table:
        pages = unpacked_pages(table)
        found = {t for page, hits in zip(pages, recurring_blocks(pages, run_tokens)) for t, hit in zip(page, hits) if hit}
        return pa.table({"n_h": np.full(len(found), table.column("h")[0].as_py(), np.int64), "text": pa.array(sorted(found), pa.string())})
    found = packs.groupBy("h", "shard").applyInArrow(run, "n_h long, text string")
    return found.select("n_h", F.xxhash64("text").alias("n_block")).distinct()


def common_blocks(marked: DataFrame, nominated: DataFrame, min_pages: int) -> DataFrame:
    """(c_h, common): per host the hashes of nominated main blocks on ``min_pages`` and more than half of its distinct pages; few, as each takes half."""
    pages = marked.groupBy(F.col("h").alias("p_h")).agg(F.countDistinct("content").alias("pages"))
    each = marked.select("h", "content", F.explode(F.array_distinct(F.transform("main", lambda t: F.xxhash64(t)))).alias("block"))
    each = each.join(nominated, (F.col("h") == F.col("n_h")) & (F.col("block") == F.col("n_block")), "left_semi")
    often = each.groupBy("h", "block").agg(F.countDistinct("content").alias("n")).where(F.col("n") >= min_pages)
    often = often.join(pages, F.col("h") == F.col("p_h")).where(2 * F.col("n") > F.col("pages"))
    return often.groupBy(F.col("h").alias("c_h")).agg(F.collect_list("block").alias("common"))


def marked_texts(marked: DataFrame, run_tokens: int, min_pages: int, shard_bytes: int) -> DataFrame:
    """(page_id, url, text) of pages with main blocks."""
    common = stored(common_blocks(marked, nominated_blocks(marked, run_tokens, min_pages, shard_bytes), min_pages), "html-blocks")
    rows = marked.join(common, F.col("h") == F.col("c_h"), "left")
    whole = F.array_join("main", "\n\n")
    left = F.array_join(F.filter("main", lambda t: ~F.array_contains("common", F.xxhash64(t))), "\n\n")
    text = F.when(F.col("common").isNotNull() & (2 * F.length(left) >= F.length(whole)), left).otherwise(whole)
    return rows.select("page_id", "url", text.alias("text"))


def _blocks(table: pa.Table) -> list[list[tuple[str, str]]]:
    return [[(b["place"], b["text"]) for b in x] for x in table.column("blocks").to_pylist()]


def open_texts(pages: DataFrame, run_tokens: int, min_pages: int, min_share: float, shard_bytes: int) -> DataFrame:
    """(page_id, url, text) of open pages; the other pages of their hosts feed the counts."""
    pages = pages.where(F.size("blocks") > 0)
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b["text"]))
    hosts = pages.groupBy(F.col("h").alias("o_h")).agg(F.sum(size).alias("bytes"), F.max("open").alias("open"), F.countDistinct("content").alias("pages"))
    least = F.greatest(F.lit(min_pages).cast("long"), F.ceil(F.col("pages") * min_share))
    hosts = stored(hosts.where("open").select("o_h", F.ceil(F.col("bytes") / shard_bytes).alias("shards"), least.alias("least")), "html-hosts")
    dealt = pages.join(sent(hosts), F.col("h") == F.col("o_h")).withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), "shards"))
    dealt = dealt.select("h", "shard", "page_id", "url", "blocks", "open", "content")  # dealt by host and shard: a host is not one task

    def count(table: pa.Table) -> pa.Table:
        run, content = shard_runs(_blocks(table), table.column("content").to_numpy(), run_tokens)
        return pa.table({"h": np.full(len(run), table.column("h")[0].as_py(), np.int64), "run": run, "content": content})
    counted = dealt.groupBy("h", "shard").applyInArrow(count, "h long, run long, content long")
    counted = counted.groupBy("h", "run").agg(F.countDistinct("content").alias("n")).where(F.col("n") >= min_pages)
    common = counted.join(hosts, F.col("h") == F.col("o_h")).where(F.col("n") >= F.col("least"))
    common = common.select("h", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = uncommon_texts(_blocks(left), right.column("run").to_numpy(), run_tokens)
        return pa.table({"page_id": left.column("page_id"), "url": left.column("url"), "text": pa.array(texts, pa.string())})
    return dealt.where("open").groupBy("h", "shard").cogroup(common.groupBy("h", "shard")).applyInArrow(run, "page_id long, url string, text string")


def extract(pages: DataFrame, run_tokens: int = RUN_TOKENS, min_pages: int = MIN_PAGES, shard_bytes: int = SHARD_BYTES,
            min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages`` (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = stored(parsed_pages(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(host).alias("h"), html.alias("html"))), "html-parsed", compression="zstd")
    rows = rows.withColumn("main", _texts("main")).withColumn("marked", F.size("main") > 0)
    rows = rows.withColumn("open", ~F.col("marked") & F.exists("blocks", lambda b: b["place"] == "open"))
    content = F.when(F.col("marked"), F.xxhash64("main")).when(F.col("open"), F.xxhash64(_texts("open"))).otherwise(F.xxhash64("blocks"))
    rows = rows.withColumn("content", content)
    marked = rows.where("marked").select("page_id", "url", "h", "main", "content")
    bare = rows.where(~F.col("marked") & ~F.col("open")).select("page_id", "url", F.lit("").alias("text"))
    texts = marked_texts(marked, run_tokens, min_pages, shard_bytes).unionByName(open_texts(rows, run_tokens, min_pages, min_share, shard_bytes)).unionByName(bare)
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
