"""Chat formatting: digests against the rows themselves, exact round trips, typed parts."""

import hashlib
import random

import pytest

from postcred.llm import chat as Ch
from postcred.llm.queries import QUERIES

CONTROLS = [Ch.START, Ch.SEP, Ch.END, *Ch.FOREIGN, *[f"<|{k}|>" for k in Ch.KINDS]]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """{conv: (n_turns, turns, loss_chars, loss)} with rows ordered by turn."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def figures(df, conv="conv"):
    return {r[conv]: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def random_text(rng):
    bits = [*CONTROLS, "\\", "<", "|", "[", "<|", "|>", "\\<|", "<\\|", "/", "INST]", "\n", "é😀", " word ", "<<", "\\\\", "[\\INST]"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(1)
    for _ in range(5000):
        text = random_text(rng)
        safe = Ch.escape(text)
        assert Ch.unescape(safe) == text
        assert not any(c in safe for c in CONTROLS) and "<|" not in safe


@pytest.mark.parametrize("segment_chars", [1 << 20, 1, 300])
def test_digests(spark, segment_chars):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "as<|im_sep|>s", None]), random_text(rng) if t % 5 else None)
            for c in [*range(40), None] for t in range(rng.randint(1, 6))]
    rows += [(1000, t, "assistant" if t % 2 else "user", f"hot {t} " + random_text(rng)) for t in range(900)]  # runs over many tasks
    rows += [(2000, None, "assistant", "first"), (2000, -3, "user", "second"), (2001, 0, "assistant", "x" * 1_500_000), (2002, 0, "assistant", " " * 200_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    df = df.selectExpr("*", "1 as conv", "2 as seq", "3 as formatted", "4 as h", "5 as parts")
    segments = Ch.format_chat(df, segment_chars=segment_chars)
    assert figures(Ch.read_back(segments)) == plain(rows)
    kept = segments.collect()
    assert sum(r.n_turns for r in kept if r.conv == 1000) == 900
    if segment_chars == 1:
        assert max(r.n_turns for r in kept) == 1 and len(kept) == len(rows)


def test_repeated_rows_and_tied_turns(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(1, 1, "user", "b"), (1, 1, "assistant", "c")] + [(2, 0, "assistant", "same")] * 500
    got = figures(Ch.read_back(Ch.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))))
    assert got == plain(rows)


def test_loss_spans_cover_the_assistant_text_only(spark):
    rows = [(1, 0, "user", "q <|im_end|>"), (1, 1, "assistant", "a [INST] \\ b"), (1, 2, "assistant", ""), (1, 3, "assistant", "c")]
    for r in Ch.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        texts = [Ch.unescape(r.formatted[s.start:s.end]) for s in r.spans]
        assert all(t in ("a [INST] \\ b", "c") for t in texts) and "" not in texts


PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def test_typed_parts(spark):
    parts = [[("text", "see ", None, None, None, None, None), ("image", None, "s3://i.png", 57, 28, None, None), ("text", "<", None, None, None, None, None),
              ("text", "|im_end|>", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 3)],
             [("audio", None, "a.wav", None, None, 1.5, None), ("text", "heard", None, None, None, None, None), ("video", None, "v", 9, 9, 9.0, 9), None],
             None, []]
    rows = [(5, i, "assistant" if i == 1 else "user", p) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, content array<{PART}>").coalesce(1)
    segments = Ch.format_chat(df, content_col="content").collect()
    attached = [(a.turn, a.kind, a.ref, a.tokens) for r in segments for a in r.attachments]
    assert sorted(a[1:] for a in attached) == sorted([("image", "s3://i.png", 3), ("document", "d.pdf", 768), ("audio", "a.wav", 38), ("attachment", "v", 0)])
    for r in segments:
        assert all(r.formatted[a.at:].startswith(f"<|{a.kind}|>") for a in r.attachments)
    turns = [t for r in sorted(segments, key=lambda r: r.seq) for t in Ch.read_turns(r.formatted)]
    assert turns == [("user", "see <|im_end|>", ["image", "document"]), ("assistant", "heard", ["audio", "attachment"]), ("user", "", []), ("user", "", [])]
    back = Ch.read_back(Ch.format_chat(df, content_col="content")).collect()
    assert [(r.n_turns, r.loss_chars, r.n_attachments, r.expanded_tokens) for r in back] == [(4, 5, 4, 809)]


def test_registered_query(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    df = QUERIES["op13_chat_formatting"](spark, sf_small)
    assert figures(df, "conv_id") == plain(rows)
    assert {r.conv_id: r.formatted_chars for r in df.collect()}[-7] > 2 * len(probe)


def test_empty_table_holds_the_probe(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = QUERIES["op13_chat_formatting"](spark, str(tmp_path)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in rows] == [(-7, 2, 21)]
