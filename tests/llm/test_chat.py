import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from loomery.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, seq int, messages string"
PARTS = st.sampled_from([*C.CONTROLS, "<\\s>", "<\\\\/s>", "[\\INST]", "\\", "<", "[", "\n", "a", "é", "😀", "|im_start|>", " "])
TEXT = st.none() | st.lists(PARTS, max_size=6).map("".join)


def said(rows):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows).encode()).hexdigest()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", None, "a\nb\\n", "</s>"]), TEXT), min_size=1, max_size=5), min_size=1, max_size=20))
def test_round_trip(spark, convs):
    rows = [(c, k, r, t, 0, "m") for c, turns in enumerate(convs) for k, (r, t) in enumerate(turns)]
    got = {r.conv_id: r for r in C.digests(C.render(C.fold(C.as_events(spark.createDataFrame(rows, SCHEMA))))).collect()}
    for c, turns in enumerate(convs):
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), said(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_control_string_survives(spark):
    rows = [(1, 0, "user", "".join(C.CONTROLS), 0, "")]
    out = C.render(C.fold(C.as_events(spark.createDataFrame(rows, SCHEMA)))).first().formatted
    assert out.count(C.START) == out.count(C.STOP) == 1
    assert not any(c in out for c in C.CONTROLS if c not in (C.START, C.STOP))


def test_events(spark):
    e = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", "he"), (1, 3, "delta", 1, None, "llo"), (1, 4, "edit", 0, None, "HI"),
        (1, 5, "message", 2, "user", "bye"), (1, 6, "regenerate", 1, "assistant", "Yo"), (1, 7, "delta", 1, None, "!"), (2, 1, None, 5, None, None), (None, 1, "message", 0, "user", "x"),
    ]
    df = spark.createDataFrame(e, "conv_id long, seq long, event string, turn long, role string, text string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in C.fold(df).collect()}
    assert got == {1: [(0, "user", "HI"), (1, "assistant", "Yo!")], 2: [(5, "", "")], None: [(0, "user", "x")]}
    assert C.render(C.fold(df.limit(0))).count() == 0


def test_ties_repeats_and_long_texts(spark):
    rows = [(1, 0, "user", "b", 0, ""), (1, 0, "user", "a", 0, ""), (1, 0, "user", "a", 0, ""), (1, None, "system", "s", 0, ""), (2, 0, "assistant", "x<s>" * 50_000, 0, "")]
    got = {r.conv_id: r for r in C.digests(C.render(C.fold(C.as_events(spark.createDataFrame(rows, SCHEMA))))).collect()}
    assert got[1].turns_sha256 == said([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")])
    assert got[2].loss_chars == 200_000 and got[2].formatted_chars == 250_000 + len(C.START + "assistant\n" + C.STOP + "\n")


def test_spans_hold_the_loss_texts(spark):
    rows = [(1, 0, "user", "hé<s>", 0, ""), (1, 1, "assistant", "😀[INST]a\nb", 0, ""), (1, 2, "assistant", "", 0, ""), (1, 3, "user", "assistant\n", 0, ""), (1, 4, "assistant", "c", 0, ""), (2, 0, "user", "x", 0, "")]
    out = C.render(C.fold(C.as_events(spark.createDataFrame(rows, SCHEMA))))
    text = {r.conv_id: r.formatted for r in out.collect()}
    spans = sorted(map(tuple, C.loss_spans(out).collect()))
    assert [(c, text[c][s : s + n]) for c, s, n in spans] == [(1, "😀[\\INST]a\nb"), (1, ""), (1, "c")]
