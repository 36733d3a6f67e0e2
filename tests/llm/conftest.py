import random

import pytest


@pytest.fixture(scope="session")
def odd_docs():
    """(doc_id, text): nulls, empty and blank texts, exact and near copies, shared lines, secrets, odd spaces, one long text."""
    rng = random.Random(3)
    vocab = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(300)]
    line = "THIS line is long enough to count as a repeated line of a page"
    texts = [None, "", " \t\n", "one", "two words", "\n\n", "a b c\x1cd e", "😀 " * 60, "x\n" * 70]
    base = " ".join(rng.choice(vocab) for _ in range(400))
    texts += [base, base, base.upper(), base + " tail"]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 200))) + "\n  " + (line if k % 2 else line.lower()) + "\t\nend " + str(k)
              for k in range(12)]
    texts += ["password = 'abc' token: abcdefgh12345 SECRET=zzzzzzzzz api_key:\"q1w2e3r4t5", "AKIAABCDEFGHIJKL12 AKIASHORT " + "0f" * 20 + "é" + "ab" * 5,
              "😀 apikey=ABCDEFGH AKIA" + "Z" * 30]
    texts += [" ".join(rng.choice(vocab) for _ in range(30_000))]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_docs, tmp_path_factory):
    """A data folder with the odd documents, pages, items and labels."""
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars") \
        .write.parquet(f"{d}/documents.parquet")
    items = [(1, odd_docs[9][1][:200]), (2, "absent words only here and nowhere else at all"), (3, None), (4, ""), (5, "two words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    page = "<html><body><nav>Menu Home</nav><article><h1>T&amp;t</h1><p>One  \n two</p></article><footer>foot</footer></body></html>"
    pages = [(1, "http://a.b/1", page), (2, "http://a.b/1", page), (3, None, None), (4, "not a url", ""), (5, "http://a.b/\n2", "<p>plain é"),
             (6, "http://[bad", page), (7, "http://a.b/3", "a\r\n\r\nb\r\n\r\n")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    labels = [(i, 1, i % 2) for i, _ in odd_docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, [0.5, 1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="session")
def no_rows(spark, odd, tmp_path_factory):
    """The same tables without rows."""
    d = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "benchmark", "pages", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d
