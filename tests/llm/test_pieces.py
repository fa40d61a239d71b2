import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomery.llm import piece_codec as P


def scan(c, text, size):
    """Encoding by chunks of ``size`` characters, each traced back on its own."""
    s, free_in, rows, matrices = c.normal(text), True, [], []
    for k, (a, b, free) in enumerate(c.split(s, size)):
        r = (s[max(0, a - c.longest) : a], s[a:b], s[b : b + 2 * c.longest], k == 0, free_in, free)
        rows.append(r)
        matrices.append(c.transfer(*r))
        free_in = free
    at, out = P.borders(matrices), []
    for k, r in enumerate(rows):
        entry = ("", 0) if r[3] or r[4] else c.states(r[0], r[1] + r[2])[at[k]]
        exit_ = ("", 0) if r[5] else c.states(r[0] + r[1], r[2])[at[k + 1]]
        out += c.trace_back(r[0], r[1], r[2], entry, exit_, r[5])
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehilnorstéß  \n\t0123中😀.,!<>"), max_size=80) | st.text(max_size=40))
def test_equals_library(text):
    c = P.codec()
    text = text.encode("utf-8", "ignore").decode().replace("\0", "")
    assert c.encode(text) == c.sp.encode(text)
    if "▁" not in text:
        assert c.decode(c.encode(text)) == c.sp.decode(c.sp.encode(text))


def test_chunked_scan_equals_whole():
    c, rng = P.codec(), random.Random(1)
    for _ in range(150):
        s = "".join(rng.choice(["the", "ing", "er", "tion", "a", "b", "he", "llo", "中", "éß", " ", "  ", "\n", "x"]) for _ in range(rng.randint(1, 80)))
        for size in (5, 17, 40):
            assert scan(c, s, size) == c.sp.encode(s)
            assert scan(c, s.replace(" ", "").replace("\n", ""), size) == c.sp.encode(s.replace(" ", "").replace("\n", ""))


def test_products_are_associative():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b, d = (np.where(rng.random(s) < 0.5, -np.inf, 0.0) for s in ((3, 4), (4, 2), (2, 5)))
    assert (P.combine(P.combine(a, b), d) == P.combine(a, P.combine(b, d))).all()


def test_documents(spark):
    rng = random.Random(3)
    long = "".join(rng.choice(["the", "ing", "er", " a", "\n"]) for _ in range(4000))
    rows = [(1, "Hello world", "t", 1), (2, None, "t", 1), (3, "", "t", 1), (4, long, "t", 1), (5, long.replace(" ", "").replace("\n", ""), "t", 1), (1, "Hello world", "t", 1), (None, " two  blanks ", "t", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, n_tokens int")
    got = P.decode(P.encode(df, giant=500)).collect()
    assert sorted(map(str, P.encode(df, giant=500, decoded=True).select(*sorted(got[0].asDict())).collect())) == sorted(str(type(r)(**{k: r[k] for k in sorted(r.asDict())})) for r in got)
    assert len(got) == len(rows)
    for r in got:
        assert r.decoded == r.text
        assert r.token_ids == (None if r.text is None else P.codec().sp.encode(r.text)) and r.n_tokens == (None if r.text is None else len(r.token_ids))
    assert P.encode(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "ab " * 400, 7, 8, "x"), (2, "c", 7, 8, "x")], "doc_id bigint, text string, _key int, chunk int, DECODED string")
    got = P.encode(df, giant=500, decoded=True)
    assert got.columns == ["doc_id", "text", "_key", "chunk", "token_ids", "decoded", "n_tokens"]
    assert all((r._key, r.chunk, r.decoded) == (7, 8, r.text) for r in got.collect())
