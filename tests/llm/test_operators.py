"""Operators on their general interface: clashing columns, repeated rows, null ids, hot cells, ledgers, merges, plans, stages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postcred.llm import packing, secrets, simhash, warc
from postcred.llm.common import packed, span_hashes
from postcred.llm.components import connected_components
from postcred.llm.decontaminate import contained_items, drop_contaminated
from postcred.llm.html import blocks_of, extract, repeated_runs, shard_texts
from postcred.llm.lattice import prior, public_vocabulary
from postcred.llm.lines import drop_repeated_lines
from postcred.llm.quality import keep_good, quality_rows
from tests.llm import brute

CLASH = "doc_id long, text string, id long, rk string, cell int, blob string, w string, gone string"
LINE = "a boilerplate line that many of the documents of the table have"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 9, "r", 1, "b", "w", "g") for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def clash(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good), (1, good), (2, good + " more"), (None, good), (None, None), (3, ""), (3, None)]
    rows += [(10 + k, f"{LINE}\nown {k}") for k in range(6)]
    return clashing(spark, rows), rows


def test_filters_keep_columns_and_repeated_rows(clash):
    docs, rows = clash
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if t and t.startswith("word0"))
    assert quality_rows(packed(docs, "doc_id", "text")).count() == len(rows)


def test_line_dedup_on_clashing_rows(clash):
    docs, rows = clash
    out = drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = {r.doc_id: r.text for r in out.where("doc_id >= 10").collect()}
    assert got == {10 + k: f"own {k}" for k in range(5)} | {15: f"{LINE}\nown 5"}
    assert out.count() == len(rows)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (7, 3)])
def test_line_dedup_is_the_same_for_any_batching(spark, odd_docs, batches, fanout):
    docs = spark.createDataFrame(odd_docs, "doc_id long, text string")
    want = {d: t for d, (_, _, t) in brute.line_dedup(odd_docs).items()}
    assert {r.doc_id: r.text for r in drop_repeated_lines(docs, batches=batches, fanout=fanout).collect()} == want


def test_one_row_per_near_copy_group(clash):
    docs, _ = clash
    out = simhash.keep_one_per_group(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert sum(t is not None and t.startswith("word0") for t in texts) <= 2 and sum(not t for t in texts) == 1


@pytest.mark.parametrize("max_cell", [4096, 8])
def test_links_are_whole_with_and_without_hot_cells(spark, max_cell):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for _ in range(6):
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    fps |= {0, 1, 2, 3, 7, (1 << 64) - 1}
    fps = sorted(fps)
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)]
    rows = spark.createDataFrame([(i, 0, x) for i, x in signed], "id long, rk long, fp long")
    got = {r.fp: r.component_id for r in simhash.fingerprint_classes(rows, max_cell=max_cell).collect()}
    assert [got[x] for _, x in signed] == brute.components(fps)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(51)} | {k: 100 for k in range(100, 160)}


def test_decontamination_drops_holders_only(spark, clash):
    docs, rows = clash
    items = spark.createDataFrame([(1, " ".join(f"WORD{i}," for i in range(5, 25))), (1, None), (None, "")], "item_id long, text string")
    out = drop_contaminated(docs, items)
    assert out.columns == docs.columns
    assert Counter(r.text for r in out.collect()) == Counter(t for _, t in rows if not (t and t.startswith("word0")))


def test_decontamination_keeps_to_builtin_functions(spark, sf_small):
    docs, items = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = contained_items(docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_ledger_scans_only_what_is_new(spark, odd_docs, tmp_path):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame(odd_docs, "doc_id long, text string")
    first = secrets.find_secrets(docs.where("doc_id < 40"), ledger_path=path).count()
    n = spark.read.parquet(path).count()
    more = {r.doc_id: r.spans for r in secrets.find_secrets(docs, ledger_path=path).collect()}
    assert first and spark.read.parquet(path).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count() > n
    secrets.find_secrets(docs, ledger_path=path).count()
    assert spark.read.parquet(path).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    fresh = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    assert more == fresh


def test_rule_versions(spark, tmp_path):
    """A raised, a removed and a returning rule: always what a fresh scan with those rules finds, and only new pairs are scanned."""
    import re
    path = str(tmp_path / "ledger")
    rows = [(1, "x " + "0f" * 20 + " y"), (2, "AKIA" + "Q" * 16 + " " + "ab" * 40), (2, "AKIA" + "Q" * 16 + " " + "ab" * 40), (None, "0f" * 20), (None, None),
            (3, "x " + "0f" * 20 + " y"), (4, "token=abcdefghij")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as blob", "2 as id", "3 as spans", "4 as todo")
    old = secrets.RULES
    raised = tuple((k, 2, re.compile(r"[0-9a-f]{64,}"), g, 64, m) if k == "hex" else (k, v, p, g, n, m) for k, v, p, g, n, m in old)
    removed = tuple(r for r in old if r[0] != "hex")

    def found(rules, ledger=None):
        return sorted(((r.doc_id, r.blob, [tuple(s) for s in r.spans]) for r in secrets.find_secrets(docs, ledger_path=ledger, rules=rules).collect()), key=repr)

    sizes = []
    for rules in (old, raised, removed, old, raised):
        assert found(rules, path) == found(rules)
        sizes.append(spark.read.parquet(path).count())
    blobs = len({t or "" for _, t in rows})
    assert sizes == [blobs, 2 * blobs, 2 * blobs, 2 * blobs, 2 * blobs]  # the raised rule alone was new
    assert [s for _, _, s in found(raised, path) if s and s[0][0] == "hex"] == [] and len(found(old, path)) == len(rows)


def test_tags_are_read_by_position():
    cases = {"<p>one <a title=it's>two</a> three</p><p>don't stop</p><p>four</p>": ["one two three", "don't stop", "four"],
             "<p a=\"x>y\" b='>' c=d\"e>t</p>": ["t"], "<p =x>t</p>": ["t"], "<p title='open>rest": [],
             "<div title='class=ad'>kept</div><div hidden>no</div><div style='display : none'>no</div>v": ["kept", "v"],
             "<article><p>a</p><div class='social-history'>b</div><div class=\"comment-list\">c</div><div class=share-buttons>d</div></article>": ["a", "b"]}
    for page, want in cases.items():
        assert [t for place, t in blocks_of(page) if place != "out"] == want


def test_tags_do_not_backtrack(two_minutes):
    for page in ("<a " + "x='" * 100_000, "<p " + "= " * 100_000, "<" * 100_000, "<a " * 100_000, "<p " + "a=b" * 300_000):
        blocks_of(page)


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert [runs[w][i] for w, i in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_capture_history_is_globally_ordered(spark, odd, tmp_path):
    pages = spark.read.parquet(f"{odd}/pages.parquet")
    rows = warc.capture_history(pages, str(tmp_path / "w"), records_per_file=1).collect()
    keys = [(r.url_key, r.captured_at, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(rows) == pages.count()


def test_archives_are_cut_by_bytes(spark, tmp_path):
    """Small, middle and huge pages: no file holds more than its bytes, but for a record that is larger itself; all come back."""
    import glob
    import gzip
    sizes = [5] * 40 + [90] * 30 + [1500] * 20 + [30_000] * 9 + [400_000]
    df = spark.createDataFrame([(i, f"http://h/{i}", f"{i:05d}" + "x" * n) for i, n in enumerate(sizes)] + [(None, None, None)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    rows = warc.capture_history(df, path, file_bytes=1 << 17).collect()
    assert sorted((r.page_id is None, r.page_id, r.payload_bytes) for r in rows if r.page_id is not None) == [(False, i, n + 5) for i, n in enumerate(sizes)]
    assert len(rows) == len(sizes) + 1
    for name in glob.glob(f"{path}/**/*.gz", recursive=True):
        raw = gzip.decompress(open(name, "rb").read())
        payload = sum(len(block.partition(b"\r\n\r\n")[2]) for _, _, block in warc.records(open(name, "rb").read()))
        assert payload <= 1 << 17 or len(list(warc.records(open(name, "rb").read()))) == 1, len(raw)


@pytest.fixture
def two_minutes():
    """Fails a test that hangs in a library call, where an ordinary signal handler would never run."""
    import faulthandler
    faulthandler.dump_traceback_later(120, exit=True)
    yield
    faulthandler.cancel_dump_traceback_later()


@pytest.mark.parametrize("top,n", [(64, 3000), (256, 100_000), (1024, 30_000)])
def test_cutting_stock_covers_the_demand(spark, two_minutes, top, n):
    """In a process that has a session and has run a job: the linear program must not wait for another library's threads."""
    assert spark.range(5).mapInArrow(lambda it: it, "id long").count() == 5
    demand = np.bincount(np.random.default_rng(2).integers(1, top + 1, n), minlength=top + 1)
    plan = packing.solve(demand, top)
    assert all(sum(x * k for x, k in p.items()) <= top for p, _ in plan)
    size, total = np.arange(top + 1), (np.arange(top + 1) * demand).sum()
    placed = sum(sum(x * k for x, k in p.items()) * t for p, t in plan)
    assert sum(t for _, t in plan) * top <= (1.02 if n > 100 * top else 1.05) * placed + top  # the patterns themselves leave little open
    kept, left = packing.open_up(plan, demand, top)
    used = left.copy()
    for p, times in kept:
        for x, k in p.items():
            used[x] += k * times
    assert (used == demand).all() and (left >= 0).all()
    line = packing.gaps(kept, left, top)
    assert [g[0] for g in line] == [0, *[g[1] for g in line[:-1]]][:len(line)] and (line[-1][1] if line else 0) == (size * left).sum()
    last = max([sum(t for _, t in kept), *[g[3] + (g[1] - g[0]) // g[2] for g in line]])
    assert last <= -(-total // top) + 1


@pytest.mark.parametrize("pieces", [{600: 50}, {1024: 3}, {1: 1}, {512: 1, 256: 1}, {1000: 7, 24: 2}, {}, {700: 1, 800: 1, 5: 400}])
def test_left_over_pieces_fill_what_patterns_leave_open(pieces):
    demand = np.zeros(1025, np.int64)
    for x, n in pieces.items():
        demand[x] = n
    kept, left = packing.open_up(packing.solve(demand, 1024), demand, 1024)
    total = sum(x * n for x, n in pieces.items())
    fill: dict[int, int] = {}
    at = 0
    for p, times in kept:
        for _ in range(times):
            fill[at] = sum(x * k for x, k in p.items())
            at += 1
    for lo, hi, room, sequence, offset in packing.gaps(kept, left, 1024):
        for i in range((hi - lo) // room):
            assert fill.get(sequence + i, 0) == offset
            fill[sequence + i] = offset + room
    assert sum(fill.values()) == total and len(fill) <= -(-total // 1024) + 1
    assert sum(1024 - n for n in fill.values() if n & (n - 1)) < 1024


def test_long_runs_go_to_the_named_tokenizer(two_minutes):
    from tokenizers import Tokenizer
    names = packing.public_tokenizer()
    ids_of, plain = packing.TokenBytes(*names), Tokenizer.from_file(names[0])
    for text in (" " * 1_000_000 + "x", "\n" * 300_000, "a" * 300_000, "b " * 200_000, "x" + " " * 999 + "y", "<|endoftext|> a", "\u3000" * 5000 + "."):
        assert ids_of(text) == np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pack_odd_rows(spark, two_minutes):
    """Repeated rows, null and equal ids, clashing columns, a text of blanks: every id lies in one piece, sequences are full."""
    from tokenizers import Tokenizer
    names = packing.public_tokenizer()
    tok = Tokenizer.from_file(names[0])
    rng = random.Random(5)
    rows = [(1, "same text " * 300)] * 9 + [(None, "no id " * 100)] * 3 + [(2, None), (2, ""), (3, " " * 200_000 + "x"), (4, "w" * 60_000)]
    rows += [(i, "word " * rng.randint(1, 900)) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as length", "3 as rank", "4 as p", "5 as room", "6 as id", "7 as rk")
    got = packing.pack(df, *names).collect()
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    want, have = {}, {}
    for d, t in rows:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[d] = want.get(d, 0) + len(ids)
        for r in got:
            if r.doc_id == d and r.doc_tokens == len(ids) and r.start + r.length <= len(ids):
                have.setdefault((d, len(ids)), set()).add((r.start, r.length, r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())))
    assert all(ok for k, v in have.items() if k != (2, 1) for _, _, ok in v)
    assert {d: sum(r.length for r in got if r.doc_id == d) for d in want} == want
    assert len(sequences) <= -(-sum(want.values()) // 1024) + 1


def test_repeated_runs_against_plain_search():
    rng = random.Random(4)
    pages = [[rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(8)]
    n, least = 4, 2
    where = {}
    for i, p in enumerate(pages):
        for k in range(len(p) - n + 1):
            where.setdefault(tuple(p[k:k + n]), set()).add(i)
    want = []
    for p in pages:
        c = [False] * len(p)
        for k in range(len(p) - n + 1):
            if len(where[tuple(p[k:k + n])]) >= least:
                c[k:k + n] = [True] * n
        want += c
    got = repeated_runs(np.array(sum(pages, []), np.int64), np.repeat(np.arange(8), [len(p) for p in pages]), n, least)
    assert got.tolist() == want


def test_boilerplate_leaves_open_pages():
    pages = [f"<div>Read our terms of use before you go on</div><p>Story{k} tells of thing{k} and its kin{k}</p>" for k in range(4)]
    assert shard_texts(pages, 6, 3) == [f"Story{k} tells of thing{k} and its kin{k}" for k in range(4)]


def test_boilerplate_leaves_marked_pages(spark):
    """A whole main block on most pages of the host goes; a line of a few pages and the pages of a host of copies stay."""
    line, ask = "A line that some of the stories share", "Share this story with your friends now"
    bodies = [f"<p>Story{k} tells at length of thing{k} and its kin{k}</p>" + (f"<p>{line}</p>" if k < 4 else "") for k in range(10)]
    rows = [(k, f"http://a.b/{k}", f"<article>{b}<div class='prompt'>{ask}</div></article>") for k, b in enumerate(bodies)]
    rows += [(20 + k, f"http://c.d/{k}", f"<article><p>One story that stands here in every copy</p><p>{k}</p></article>") for k in range(4)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {k: f"Story{k} tells at length of thing{k} and its kin{k}" + (f"\n\n{line}" if k < 4 else "") for k in range(10)}
    assert got == want | {20 + k: f"One story that stands here in every copy\n\n{k}" for k in range(4)}


def test_boilerplate_counts_over_the_host(spark):
    """Open pages: the same texts for any shard size; near copies count once; the bound grows with the host's pages."""
    story = "Story{0} tells of thing{0} and its kin{0} on day{0}"
    notice, phrase = "Read our terms of use before you go on", "a phrase of six words here"
    rows = [(k, f"http://a.b/{k}", f"<div>{notice}</div><p>{story.format(k)}</p>") for k in range(12)]
    rows += [(100 + k, f"http://c.d/{k}", f"<p>{story.format(0)}</p><footer>{k}</footer>") for k in range(3)]
    rows += [(1000 + k, f"http://e.f/{k}", f"<p>{story.format(k)}{' ' + phrase if k < 3 else ''}</p>") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: story.format(k) for k in range(12)} | {100 + k: story.format(0) for k in range(3)}
    want |= {1000 + k: story.format(k) + (" " + phrase if k < 3 else "") for k in range(400)}
    for shard_bytes in (200, 4 << 20):
        assert {r.page_id: r.text for r in extract(pages, shard_bytes=shard_bytes).collect()} == want


def test_lattice_forward_equals_listing_all_segmentations():
    p = prior(public_vocabulary())
    words = ["the", "a", "été", "naïve", "😀x", "tokens"]

    def total(word):
        arcs = p.arcs(word)

        def walk(i):
            return 1.0 if i == len(arcs) else sum(np.exp(w) * walk(j) for j, _, w in arcs[i])
        return np.log(walk(0))
    want = [total(w) for w in words]
    assert [p.log_marginal(w) for w in words] == pytest.approx(want)
    assert p.log_marginals(words * 30).tolist() == pytest.approx(want * 30)
    one, many = [0.0] * len(p.names), np.zeros(len(p.names))
    for w in words:
        p.expect(w, 30.0, one)
    p.expect_all(words * 30, np.ones(len(words) * 30), many)
    assert many.tolist() == pytest.approx(one)


def test_span_hashes_depend_on_the_bytes_only():
    data = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    h = span_hashes(data, np.array([0, 3, 6, 9]), np.array([3, 6, 9, 12]))
    assert h[0] == h[1] == h[3] != h[2]


def test_stages_follow_each_other(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, sf_small), "test-stage")
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        old = docs.select("doc_id", "text").collect()
        if name == "quality rules":
            assert ids == {r.doc_id for r in QUALITY(spark, docs)}
        elif name == "line dedup":
            assert {r.doc_id: r.text for r in out.collect()} == {d: t for d, (_, _, t) in brute.line_dedup([tuple(r) for r in old]).items()}
        elif name == "simhash near-dedup":
            rows = sorted(tuple(r) for r in old)
            assert ids == {rows[r][0] for r in brute.components([brute.simhash(t) for _, t in rows])}
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").select("item_id", "text").collect()]
            assert ids == {r.doc_id for r in old} - {d for d, _ in brute.contained([tuple(r) for r in old], items)}
        docs = out
    assert 0 < docs.count() < n
    packed_ids = {r.doc_id for r in corpus_pipeline.packing(spark, docs, sf_small).select("doc_id").collect()}
    assert packed_ids == {r.doc_id for r in docs.collect()}


def QUALITY(spark, docs):
    return quality_rows(packed(docs, "doc_id", "text")).where("kept").selectExpr("id as doc_id").collect()
