"""Summarise the physical plans of the headline queries (shuffles, joins, scans) as markdown.

Usage: python scripts/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")
from postcred.operators import text as TX  # noqa: E402
from postcred.operators.lexicon import comparison_scores, lexicon_sentiment  # noqa: E402
from postcred.operators.topics import topic_doc_weight, topic_word_weights  # noqa: E402
from postcred.plans import pipeline as P  # noqa: E402
from postcred.session import build_session  # noqa: E402


def _nodes(node):
    """Physical plan nodes, looking through adaptive wrappers and query stages; cached relations
    (InMemoryTableScan) are leaves, so their one-off derivation is not walked."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _nodes(node.executedPlan())
        return
    if name.endswith("QueryStage"):
        yield from _nodes(node.plan())
        return
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def summary(name, df):
    nodes = list(_nodes(df._jdf.queryExecution().executedPlan()))
    names = [n.nodeName() for n in nodes]
    exchanges = [n.outputPartitioning().toString() for n in nodes if n.nodeName() == "Exchange"]
    exchanges = [re.sub(r"#\d+L?", "", e) for e in exchanges]
    joins = sorted({x for x in names if x.endswith("Join") or x in ("CartesianProduct",)})
    aggs = sum(1 for x in names if x.endswith("Aggregate"))
    py = "yes" if any(x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
                      for x in names) else "no"
    bucketed = "yes" if any("Bucketed: true" in n.toString() for n in nodes if n.nodeName().startswith("Scan")
                            or "FileScan" in n.toString()[:40]) else "no"
    print(f"| {name} | {len(exchanges)} | {'; '.join(exchanges) or 'none'} | {', '.join(joins) or 'none'} "
          f"| {aggs} | {bucketed} | {py} |")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16)
    raw = P.posts_from_tables(spark, sf)
    posts = P.land_posts(raw)
    sent, subj, cats = [d.cache() for d in P.fixture_lexicons(posts)]
    ltok = P.stored_tokens(posts)
    dt, tt = P.fixture_topic_tables(posts, ltok)
    weights = topic_word_weights(dt, tt, mode="marginal").cache()
    for d in (sent, subj, cats, weights):
        d.count()
    ct = TX.with_text_stats(P.comparison_text(posts), tokens="stokens", entropy=None)
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `scripts/show_plans.py` at `{sf}` (adaptive plans before execution).  The first row is the ingest;")
    print("every other row reads the landed posts: a table bucketed on the post key, so per-post aggregations")
    print("and key joins need no exchange.  Lexicons and topic weights are cached lookup tables (their one-off")
    print("derivation is not counted).\n")
    print("| query | shuffles | exchange partitioning | joins | aggregate nodes | bucketed scan | Python UDF |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    summary("posts (parse + dedup)", raw)
    summary("entropy + nfrq", TX.with_text_stats(TX.with_tokens(P.with_reach(posts)), pmi=None))
    summary("pmi (comparison text)", ct)
    summary("token_counts", TX.token_counts(TX.with_tokens(posts)))
    summary("bigram_counts", TX.bigram_counts(ct, tokens="stokens"))
    summary("lexicon_sentiment", lexicon_sentiment(posts, sent))
    summary("comparison_scores", comparison_scores(ct, subj, cats, carry=["pmi"]))
    summary("topic_doc_weight", topic_doc_weight(ltok, weights, tokens="ltokens"))
    summary("five_features", P.five_feature_frame(posts, sent, weights))
    summary("otc_score", P.otc_frame(posts, subj, cats))
    print("\nScan of the document table (column pruning):\n")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = P.posts_from_tables(spark, sf)._jdf.queryExecution().executedPlan().toString()
    for m in sorted(set(re.findall(r"FileScan parquet \[([^\]]*)\]", plan))):
        print(f"- `FileScan parquet [{m}]`")
    print(f"\n(`documents` has columns {docs.columns}; `lang` is never read.)")


if __name__ == "__main__":
    main()
