"""Every registered query on wild tables: repeated rows, null and equal ids, columns with clashing names, megabyte texts."""

import pytest

from postcred.llm.queries import QUERIES
from tests.llm import brute

LINE = "a line that is long enough to be counted and stands in many of the documents"
PASSAGE = " ".join(f"item{k}" for k in range(40))
CLASH = ["1 as id", "'x' as rk", "2 as word", "3 as c", "'y' as blob", "4 as h", "5 as h1", "6 as n", "7 as pos", "8 as chunk", "9 as length", "'z' as __row", "'q' as phrase", "10 as shard"]


@pytest.fixture(scope="module")
def wild(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("wild"))
    texts = [(1, "same words in every copy of this row " * 4)] * 6 + [(None, "nobody owns this text " * 5)] * 3 + [(None, None)] * 2 + [(2, None), (2, ""), (2, "two"), (2, "two")]
    texts += [(3, "x" * 1_000_000), (4, " " * 1_000_000), (5, "é \t" * 300_000), (6, ("long words all over " * 25_000) + PASSAGE), (None, f"front {PASSAGE} back")]
    texts += [(10 + k, f"{LINE}\nown line {k}\n  {LINE.upper()}  ") for k in range(6)] + [(7, "secret = 'abcdefghijkl' " * 30_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    docs.selectExpr("doc_id", "text", "if(doc_id = 5, null, 'en') as lang", "'s' as source", "length(text) as n_chars", *CLASH).write.parquet(f"{d}/documents.parquet")
    items = [(1, PASSAGE), (1, PASSAGE), (2, None), (3, "words that no document has in this order at all")]
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *CLASH).write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 1, i % 2) for i in range(1, 17)] + [(3, 1, None), (None, 1, 1), (4, None, 0), (4, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", *CLASH).write.parquet(f"{d}/labels.parquet")
    big = "<article>" + "<p>paragraph of a very large page</p>" * 40_000 + "</article>"
    pages = [(1, "http://a.b/1", "<p>one</p>")] * 3 + [(None, None, None)] * 2 + [(None, "http://a.b/1", "<p>one</p>"), (2, "http://a.b/2", big), (3, "", "<p " + "a='" * 200_000),
                                                                              (4, "http://a.b/4", "x" * 1_000_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", *CLASH, "'t' as text", "1 as n_chars", "'p' as payload", "1 as host").write.parquet(f"{d}/pages.parquet")
    vectors = [(1, [0.1 * k for k in range(8)])] * 3 + [(None, [0.3] * 8), (None, None)] + [(k, [((k * 7 + j * 3) % 11) / 10 for j in range(8)]) for k in range(20)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", *CLASH, "1 as x", "2 as d").write.parquet(f"{d}/embeddings.parquet")
    turns = [(1, 0, "user", "hi")] * 2 + [(None, None, None, None)] * 2 + [(1, 1, "assistant", "y" * 1_000_000), (2, 0, "assistant", " " * 500_000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", *CLASH, "1 as conv", "2 as seq", "'f' as formatted", "3 as parts").write.parquet(f"{d}/conversations.parquet")
    return d, texts, pages, vectors, turns


def rows(spark, wild, name):
    return QUERIES[name](spark, wild[0]).collect()


def by_text(wild):
    out = {}
    for i, t in wild[1]:
        out.setdefault(i, []).append(t or "")
    return out


def test_op1(spark, wild):
    got = rows(spark, wild, "op1_html_extraction")
    assert len(got) == len(wild[2]) and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.text for r in got if r.url == "http://a.b/1") == ["one"] * 4
    assert [r.text.count("\n\n") for r in got if r.page_id == 2] == [39_999] and [r.n_chars for r in got if r.page_id == 4] == [1_000_000]


def test_op2(spark, wild):
    got = rows(spark, wild, "op2_simhash_near_dedup")
    want = sorted((repr(i), f"{brute.simhash(t):016x}") for i, t in wild[1])
    assert sorted((repr(r.doc_id), r.fingerprint) for r in got) == want
    groups = {}
    for r in got:
        groups.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(c) == 1 for c in groups.values())


def test_op3(spark, wild):
    got = rows(spark, wild, "op3_warc")
    assert sorted(r.payload_bytes for r in got) == sorted(len((h or "").encode()) for _, _, h in wild[2])
    assert {(r.record_type, r.refers_to) for r in got if r.payload_bytes == 10 and r.page_id is None} == {("revisit", 1)}


def test_op4(spark, wild):
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in rows(spark, wild, "op4_decontaminate")}
    assert got == {(6, 1, 36, 36), (None, 1, 36, 36)}


def test_op5(spark, wild):
    got = rows(spark, wild, "op5_line_dedup")
    assert len(got) == len(wild[1])
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got if r.doc_id and r.doc_id >= 10) == [(10 + k, 3, 0 if k == 5 else 2) for k in range(6)]


def test_op6(spark, wild):
    got = sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_dup_lines, r.base_failed) for r in rows(spark, wild, "op6_quality_rules"))
    want = []
    for i, t in wild[1]:
        q = brute.quality(t)
        want.append((repr(i), q[0], q[1], q[3], q[5]))
    assert got == sorted(want)


def test_op7(spark, wild):
    got = rows(spark, wild, "op7_secret_scans")
    assert len(got) == len(wild[1]) and [r.n_assign for r in got if r.doc_id == 7] == [30_000]
    assert all(r.spans == "" for r in got if r.doc_id in (1, 3, 4))


def test_op8(spark, wild):
    got = rows(spark, wild, "op8_lm_scoring")
    assert len(got) == len(wild[1]) and all(r.score < 0 for r in got)
    assert len({(r.n_tokens, r.score) for r in got if r.doc_id == 1}) == 1 and {r.held_out for r in got if r.doc_id is None} == {False}
    assert sorted(r.n_tokens for r in got if r.doc_id in (3, 4)) == [1, 2]


def test_op9(spark, wild):
    got = rows(spark, wild, "op9_packing")
    total = sum(r.length for r in got)
    fills = {}
    for r in got:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 1024 and len(fills) <= -(-total // 1024) + 1 and sum(r.length for r in got if r.doc_id == 2) >= 4


def test_op10(spark, wild):
    got = rows(spark, wild, "op10_toxicity")
    assert len(got) == len(wild[1]) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and {r.held_out for r in got if r.doc_id is None} == {False}


def test_op11(spark, wild):
    got = rows(spark, wild, "op11_phrase_collocations")
    assert {r.lang for r in got} == {"en", "und"} and ("long words all over" in {r.phrase for r in got} or "long words all over long" in {r.phrase for r in got})


def test_op12(spark, wild):
    got = rows(spark, wild, "op12_embedding_whitening")
    k = max(r.component for r in got)
    assert len(got) == k * (len(wild[3]) - 1) and all(r.identity_error < 1e-4 for r in got)


def test_op13(spark, wild):
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in rows(spark, wild, "op13_chat_formatting")}
    assert got == {1: (3, 1_000_000), None: (2, 0), 2: (1, 500_000), -7: (2, 21)}
