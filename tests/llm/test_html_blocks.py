"""Boilerplate among main blocks: nominated by suffix arrays, whatever the shards, and then counted over the host."""

import random

import pyarrow as pa
import pytest

from postcred.llm import html as H


def test_recurring_blocks_by_plain_search():
    rng = random.Random(4)
    for trial in range(60):
        n, words = rng.randint(1, 7), rng.choice([2, 5, 40])
        make = lambda: " ".join(f"w{rng.randrange(words)}" for _ in range(rng.randint(1, 12)))
        shared = [make() for _ in range(3)]
        pages = [[rng.choice(shared) if rng.random() < 0.6 else make() for _ in range(rng.randint(1, 4))] for _ in range(n)]
        k = rng.choice([1, 2, 6])

        def runs(block):
            t = ["\0", *block.split(" "), *["\1"] * (k - 1)]
            return {tuple(t[i:i + k]) for i in range(len(t) - k + 1)}
        held = [set().union(*map(runs, p)) for p in pages]
        # runs may also reach over a block's end into the next block's mark; those never begin at a word or a first mark
        want = [[all(2 * sum(r in h for h in held) > n for r in runs(b)) for b in p] for p in pages]
        assert H.recurring_blocks(pages, k) == want
        often = {b for p in pages for b in p if 2 * sum(b in q for q in pages) > n}
        assert all(hit for p, hits in zip(pages, want) for b, hit in zip(p, hits) if b in often)


@pytest.mark.parametrize("shard_bytes", [4 << 20, 60])
def test_main_boilerplate_goes_through_the_suffix_arrays(spark, monkeypatch, shard_bytes):
    def page(i):
        return f"<article><p>read more</p><p>text number {i} with words of its own {i * 7} and {i * 11} and many others that are here to make it long enough</p><p>a long line that stands on every page of the host</p></article>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(9)] + [(100 + i, f"http://b.org/{i}", page(i)) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df, shard_bytes=shard_bytes).collect()}
    own = {i: f"text number {i} with words of its own {i * 7} and {i * 11} and many others that are here to make it long enough" for i in range(9)}
    assert {i: got[i] for i in range(9)} == own
    assert got[100] == f"read more\n\n{own[0]}\n\na long line that stands on every page of the host"
    monkeypatch.setattr(H, "nominated_blocks", lambda marked, *_: spark.createDataFrame([], "n_h long, n_block long"))
    assert all("read more" in r.text for r in H.extract(df, shard_bytes=shard_bytes).collect())  # nothing is dropped but by them


def test_packed_pages_hold_each_page_once(monkeypatch):
    monkeypatch.setattr(H, "PACK_CHARS", 30)
    rows = [(1, 0, 7, ["a b", "c"]), (1, 1, 8, ["d \0 e"]), (1, 0, 7, ["a b", "c"]), (2, 0, 7, ["f"]), (1, 0, 9, ["a long text of many words", "\u00e9 g"]), (1, 0, 7, ["a b", "c"]), (1, 0, 5, ["h"])]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("h", "shard", "content", "main"), r)) for r in part]) for part in (rows[:3], rows[3:5], rows[5:])]
    packs = pa.Table.from_batches(list(H.packed_pages(iter(batches))))
    assert sorted(c for x in packs.column("contents").to_pylist() for c in x) == [5, 7, 7, 8, 9]
    shard = pa.Table.from_pylist([r for r in packs.to_pylist() if (r["h"], r["shard"]) == (1, 0)] * 2)  # copies from two tasks
    assert H.unpacked_pages(shard) == [["h"], ["a b", "c"], ["a long text of many words", "\u00e9 g"]]


def test_main_texts_move_once_and_not_by_host(spark, monkeypatch):
    kept, real, plans = {}, H.stored, []
    monkeypatch.setattr(H, "stored", lambda df, name, *a, **k: kept.setdefault(name, real(df, name, *a, **k)))
    nominated = H.nominated_blocks
    monkeypatch.setattr(H, "nominated_blocks", lambda *a: plans.append(nominated(*a)) or plans[0])
    rows = [(i, f"http://a.org/{i}", f"<article><p>read more</p><p>text number {i} of the host</p></article>") for i in range(9)]
    H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert "main" not in kept["html-marked"].columns
    exchanges = [line for line in plans[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning(" in line]
    assert len(exchanges) == 2 and "shard" in exchanges[1] and "n_block" in exchanges[0]  # the packed texts, and what they nominate
