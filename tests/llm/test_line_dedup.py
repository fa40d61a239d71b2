import random
import re

from loomery.llm import line_dedup

SCHEMA = "doc_id bigint, text string, n_chars int, removed int"


def words(line):
    return frozenset(re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line)))


def brute(rows):
    """Kept text of each row by comparing all lines with all earlier ones."""
    lines = [((r[0] is None, r[0] or 0, k), words(x)) for r in rows for k, x in enumerate((r[1] or "").split("\n"))]
    lines = [x for x in lines if len(x[1]) >= line_dedup.MIN_WORDS]
    gone = {(a, s) for a, s in lines if any(b < a and 10 * len(s & t) >= 8 * len(s | t) for b, t in lines)}
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None))
            continue
        own = r[1].split("\n")
        kept = [x for k, x in enumerate(own) if ((r[0] is None, r[0] or 0, k), words(x)) not in gone]
        if len(kept) < len(own) and not "".join(kept).strip():
            continue
        out.append((r[0], "\n".join(kept)))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], SCHEMA)
    got = line_dedup.dedup_lines(df, **kw)
    assert got.columns == df.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r[0], r[1]) for r in got.collect()), key=key) == sorted(brute(rows), key=key)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 8, 12, 20, 40]))] for _ in range(40)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(vocab)
            lines.append(" ".join(line).upper() if rng.random() < 0.2 else " ".join(line))
        rows.append((rng.randrange(80) if rng.random() < 0.1 else d, "\n".join(lines)))
    check(spark, rows)


def test_large_group_needs_more_partners(spark):
    rng = random.Random(5)
    base = [f"t{k}" for k in range(30)]
    rows = []
    for d in range(90):
        line = list(base)
        for k in rng.sample(range(30), rng.randint(0, 7)):
            line[k] = f"x{rng.randrange(500)}"
        rows.append((d, " ".join(line)))
    check(spark, rows)


def test_edges(spark):
    line = "one two three four five six"
    check(spark, [(1, None), (2, ""), (3, line), (None, line), (4, f"{line}\n\nshort\n"), (4, f"{line}\n\nshort\n"), (5, "short"), (6, "short"), (7, "\n\n"), (8, (line + " ") * 2000 + "\nends here with some other words now"), (3, "other\n" + line)])


def test_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_lines_are_matched(spark):
    rows = [(1, "Les.\nhome\na b c\na b c d"), (2, "les.\nother\nhome  HOME\nb a c\nkept"), (3, "e d c b a\na b c d e f g\n\u4e2d\u6587\u6bb5\u843d\n\n"), (4, "\u4e2d\u6587\u6bb5\u843d\nd c b\n - \n\n"), (5, "Les.")]
    check(spark, rows)
    got = dict(line_dedup.dedup_lines(spark.createDataFrame([(*r, 0, 1) for r in rows], SCHEMA)).select("doc_id", "text").collect())
    assert got == {1: rows[0][1], 2: "other\nkept", 3: "a b c d e f g\n\u4e2d\u6587\u6bb5\u843d\n\n", 4: "d c b\n - \n\n"}


def test_frequent_words_are_posted_in_pairs(spark):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(14)]
    rows = [(d, "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.choice([4, 5, 6, 9, 12]))) for _ in range(6))) for d in range(70)]
    for hot in (1, 40, 100_000):
        check(spark, rows, hot=hot)


def test_clashing_columns(spark):
    schema = "doc_id bigint, text string, _removed int, _hash string, _doc int, LINES_REMOVED int, doc int, line int"
    line = "one two three four five"
    df = spark.createDataFrame([(1, line, 1, "h", 2, 3, 4, 5), (2, f"{line}\nsix", 1, "h", 2, 3, 4, 5)], schema)
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, line, 1, "h", 2, 3, 4, 5), (2, "six", 1, "h", 2, 3, 4, 5)]
    assert sorted(r.lines_removed for r in line_dedup.dedup_lines(df, details=True).collect()) == [0, 1]


def test_segments_are_sorted_together():
    """Each segment for itself, those of one size at once; what lies outside segments stays."""
    import numpy as np

    from loomery.llm import words

    rng = np.random.default_rng(4)
    size = rng.integers(0, 6, 200)
    begin = np.cumsum(size + 1) - size
    keys = rng.integers(0, 1 << 62, int(begin[-1] + size[-1] + 1)).astype(np.uint64)
    want = keys.copy()
    for a, n in zip(begin, size, strict=True):
        want[a : a + n] = np.sort(want[a : a + n])
    words.sort_segments(keys, begin, size)
    assert (keys == want).all()
    data = np.arange(256, dtype=np.uint8).repeat(2)
    start, stop = words.bounds(data, np.array([0, len(data)]))
    gaps = [c for c in range(256) if c == 32 or 9 <= c < 14]
    assert sorted(set(range(256)) - {int(data[k]) for a, b in zip(start, stop, strict=True) for k in range(a, b)}) == gaps
