import math
import random
import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from loomery.llm import langid, quality_rules
from loomery.llm import queries as Q
from loomery.runtime import table

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    got = spark.range(200).select("id", quality_rules.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_quality_on_held_out_rows(spark):
    got = Q.op2_quality_rules(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97 and got.score.between(0, 1).all()


def test_rules_as_columns_equal_rules_in_numpy(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, table(spark, SF, "labels"))
    assert model.rules and len(model.rules) < 400
    t = quality_rules.with_statistics(docs).select("_stats.*", model.column().alias("s")).toPandas()
    z = model.margin(t[list(quality_rules.NAMES)].to_numpy(float))
    assert np.allclose(1 / (1 + np.exp(-z)), t.s.to_numpy(), atol=1e-9)


def test_language_on_held_out_rows(spark):
    got = Q.op10_langid(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", F.lit("x").alias("score"))
    odd = spark.createDataFrame([(-1, None, "en", "x"), (-2, "", None, "x"), (-3, "12 34 !", "en", "x"), (None, "the and of", None, "x"), (-4, "word " * 200_000, "en", "x")], docs.schema)
    both = docs.unionByName(odd)
    pred = {r.doc_id: r for r in langid.predict(both, langid.train(both)).where("doc_id < 0 or doc_id is null").collect()}
    assert [pred[k].lang_pred for k in (-1, -2, -3)] == ["und"] * 3 and pred[None].lang_pred == "en"
    labels = table(spark, SF, "labels").unionByName(spark.createDataFrame([(-9, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int"))
    scored = quality_rules.score(both, quality_rules.train(both, labels))
    assert scored.count() == both.count() and scored.where("score is null").count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert langid.predict(docs, langid.train(docs)).first().lang_pred == "und"
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_rules.score(docs, quality_rules.train(docs, labels)).first().score == 0.5
    assert langid.predict(docs.limit(0), langid.train(docs)).count() == 0
    assert quality_rules.score(docs.limit(0), quality_rules.train(docs, labels)).count() == 0


def plain_score(model, text):
    """A text's score by a fitted ensemble, worked out anew with plain Python."""
    t, n = text or "", lambda p: len(regex.findall(p, text or ""))
    words, lines = regex.split(r"[ \t\n\x0b\f\r]+", t), t.split("\n")
    w, c = max(1, len(words) if t else 0), max(1, len(t))
    odd, stat = n(r"[#$%&*^~@=+<>{}\[\]\\/|_]"), {}
    stat |= {"chars": math.log1p(len(t)), "words": math.log1p(len(words) if t else 0), "word_len": len(t) / w, "line_len": math.log1p(len(t) / len(lines)), "odd": odd / c, "odd_per_word": odd / w}
    stat |= {"upper": n(r"\p{Lu}") / c, "digits": n("[0-9]") / c, "pipes": n(r" \| ") / w, "shouts": n("!") / w, "stops": n("[.,;:?]") / w, "lines": len(lines) / w}
    stat |= {"unique_words": len(set(words)) / w, "unique_lines": len(set(lines)) / len(lines), "tags": n("</?[a-zA-Z]") / w}
    x = [stat[k] for k in quality_rules.NAMES]
    z = model.bias
    for rule, weight in model.rules:
        if all(x[k] > cut if above else x[k] <= cut for k, above, cut in rule.conditions):
            z += weight
    for k, weight, lo, hi, mean, scale in model.linear:
        z += weight * (min(max(x[k], lo), hi) - mean) / scale
    return 1 / (1 + math.exp(-z))


def test_scores_equal_plain_python(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " a  B!\n\n<p>1 | 2</p> "), (-4, "\nÄé\t|x| \x0b"), (-5, "x" * 100_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    model = quality_rules.train(docs, table(spark, SF, "labels"))
    for r in quality_rules.score(docs, model).collect():
        assert abs(r.score - plain_score(model, r.text)) < 1e-9 and r.predicted == (r.score >= quality_rules.CUT)


def test_lasso_is_optimal():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(300, 12))
    y = (z[:, 0] - 0.5 * z[:, 1] + rng.normal(size=300) > 0).astype(float)
    penalty = 0.03
    w, b = quality_rules._lasso(z, y, penalty, rounds=4000)
    p = 1 / (1 + np.exp(-(z @ w + b)))
    slope = z.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-6 and 0 < (w != 0).sum() < 12
    assert np.all(np.abs(slope[w == 0]) <= penalty + 1e-6) and np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-6)


def test_disagreeing_labels_do_not_teach(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id bigint, text string")
    both = [(k, q) for k in range(40) for q in (0, 1)]
    assert quality_rules.train(docs, spark.createDataFrame(both, "doc_id bigint, quality int")).rules == []
    same = spark.createDataFrame([(k, 1) for k in range(40) for _ in range(2)] + both[:20], "doc_id bigint, quality int")
    assert quality_rules.score(docs, quality_rules.train(docs, same)).first().score > 0.99


def plain_grams(text):
    """Counts of the buckets of a text's n-grams, one n-gram at a time."""
    mask = (1 << 64) - 1

    def mixed(x):
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * mul & mask
        return x ^ (x >> 31)

    s = " " + "".join("0" if c in "0123456789" else " " if c in "\t\n\x0b\x0c\r " else c for c in text.lower()) + " "
    out = {}
    for i in range(len(s)):
        h = 0
        for k in range(min(3, len(s) - i)):
            h = h + (ord(s[i + k]) + (k > 0)) * (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[k] & mask
            at = mixed(h + k & mask) >> (64 - langid.BITS)
            out[at] = out.get(at, 0) + 1
    return out


def test_predictions_equal_plain_python(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.where("length(text) < 600").limit(60).collect()] + [(-1, "Ä 中 ß", None), (-2, "9 !", None), (-3, "x", None)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, docs.schema), model).collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        grams = plain_grams(text)
        z = [(sum(n * model.weights[b, c] for b, n in grams.items()) / sum(grams.values()) + model.bias[c]) / model.temperature for c in range(len(model.langs))]
        p = [math.exp(v - max(z)) / sum(math.exp(u - max(z)) for u in z) for v in z]
        assert got[i].lang_pred == model.langs[p.index(max(p))] and abs(got[i].score - max(p)) < 1e-9


def test_ftrl_equals_plain_python():
    rng, classes = random.Random(1), 3
    rows = [(np.array(sorted(rng.sample(range(20), 5))), np.array([rng.random() for _ in range(5)])) for _ in range(30)]
    y = np.array([rng.randrange(classes) for _ in rows])
    w, bias = langid.ftrl(rows, y, classes, epochs=2, seed=3)
    alpha, beta, l1, l2 = 0.5, 1.0, 1e-4, 1e-4
    z, n = ({(i, c): 0.0 for i in [*range(20), -1] for c in range(classes)} for _ in range(2))

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True), (-1, 1.0)]
            ws = {(i, c): weight((i, c)) for i, _ in x for c in range(classes)}
            logits = [sum(v * ws[i, c] for i, v in x) for c in range(classes)]
            p = [math.exp(v) / sum(map(math.exp, logits)) for v in logits]
            for i, v in x:
                for c in range(classes):
                    g = v * (p[c] - (y[r] == c))
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha * ws[i, c]
                    n[i, c] += g * g
    assert all(abs(w[i, c] - weight((i, c))) < 1e-9 for i in range(20) for c in range(classes))
    assert all(abs(bias[c] - weight((-1, c))) < 1e-9 for c in range(classes))


def test_windows_of_long_texts_count_the_same(monkeypatch):
    rng = random.Random(2)
    for size in (1, 2, 3, 50, 400):
        text = "".join(rng.choice("aBcd 1\tÄ中") for _ in range(size))
        for cut in (1, 2, 7, 1000):
            monkeypatch.setattr(langid, "_CUT", cut)
            got = langid.gram_counts(text)
            assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == plain_grams(text)
    monkeypatch.undo()
    g, off = langid.grams(["ab", "", "Äx 1"])
    assert all(sorted(g[off[k] : off[k + 1]].tolist()) == sorted(b for b, n in plain_grams(t).items() for _ in range(n)) for k, t in enumerate(["ab", "", "Äx 1"]))
