"""The operators' registered queries, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import chat_format, embed_dedup, langid, line_dedup, minhash, mixing, piece_codec, quality_rules, vptree, warc
from loomery.runtime import Scratch, table

#: The contract's threshold for documents, in percent.
NEAR_PERCENT = 85
COSINE = 0.9
K = 5
#: The mixing plan: levels of the tree, weights by path, and the part of all tokens to take.
MIX_WEIGHTS = {("d0",): 2.0, ("d1",): 1.0, ("d2",): 1.0, ("d0", "en"): 2.0, ("d1", "en"): 2.0, ("d2", "en"): 2.0}
MIX_SHARE = 0.6
MIX_EPOCHS = 2


def mix_levels() -> dict[str, F.Column]:
    """Domains are groups of sources: the last digit of the source's name modulo 3 (null and others: d0)."""
    digit = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("source", r"(\d)$", 1), F.lit("")), F.lit("9")).cast("int"), F.lit(0))
    return {"domain": F.concat(F.lit("d"), F.pmod(digit, F.lit(3)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.dedup_lines(docs.select("doc_id", "text"), details=True)
    return out.select("doc_id", F.length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"), F.col("lines_removed").cast("bigint").alias("lines_removed"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    out = quality_rules.score(docs, model)
    return out.select("doc_id", quality_rules.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), COSINE)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.render(chat_format.fold(chat_format.as_events(rows))))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = piece_codec.encode(docs, decoded=True)
    return out.select("doc_id", "n_tokens", "token_ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), NEAR_PERCENT)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "archive").root
    warc.write(table(spark, sf_dir, "pages"), root)
    return warc.read(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, mix_levels(), MIX_SHARE, MIX_WEIGHTS, MIX_EPOCHS)
    return out.select("doc_id", "lang", "source", F.col("epoch").cast("int").alias("epoch"), "n_tokens", F.length("text").cast("bigint").alias("n_chars"))


def op9_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors.where(F.col("vec_id") % 50 == 0), vptree.build_index(vectors), K)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predict(docs, langid.train(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_embedding_dedup, op4_chat_format, op5_piece_codec, op6_minhash, op7_warc, op8_mixing, op9_vptree, op10_langid, pipeline)
}

_TAILS = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"



def _mixing_sql() -> str:
    """The mixing query level by level; the weights are those of MIX_WEIGHTS."""
    names = ("domain", "lang", "source")
    one = lambda c: f"coalesce(length({c}) || ':' || {c}, '-')"
    ctes = [
        "t AS (SELECT doc_id, text, coalesce(text, '') AS x, lang, source, 'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9])$', 1), '') AS INT), 0) % 3) AS domain FROM documents)",
        rf"d AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))::BIGINT AS n, md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(x)) AS key, {' || '.join(map(one, names))} AS leaf FROM t)",
        f"l AS (SELECT leaf, domain, lang, source, sum(n)::BIGINT AS tokens, (sum(n) * {MIX_EPOCHS})::BIGINT AS cap FROM d GROUP BY ALL)",
        f"b0 AS (SELECT least(floor({MIX_SHARE}::DOUBLE * sum(tokens)::DOUBLE + 1e-9), sum(cap)::DOUBLE) AS budget FROM l)",
    ]
    for k in range(1, 4):
        own, parent = ", ".join(names[:k]), names[: k - 1]
        weight = "CASE " + " ".join(f"WHEN {' AND '.join(f'{n} = {v!r}' for n, v in zip(names, p, strict=False))} THEN {w}::DOUBLE" for p, w in MIX_WEIGHTS.items() if len(p) == k) + " ELSE 1::DOUBLE END" if k < 3 else "1::DOUBLE"
        same = lambda a, b, p=parent: " AND ".join([f"{a}.{n} IS NOT DISTINCT FROM {b}.{n}" for n in p] or ["true"])
        cols, by = "".join(f"{n}, " for n in parent), f"PARTITION BY {', '.join(parent)} " if parent else ""
        ctes += [
            f"n{k} AS (SELECT {own}, sum(cap)::BIGINT AS cap, {weight} AS w FROM l WHERE cap > 0 GROUP BY {own})",
            f"k{k} AS (SELECT n.*, b.budget, n.cap::DOUBLE / n.w AS r FROM n{k} n JOIN b{k - 1} b ON {same('n', 'b')})",
            f"g{k} AS (SELECT {cols}r, sum(cap)::BIGINT AS cap, sum(w) AS w, any_value(budget) AS budget FROM k{k} GROUP BY {cols}r)",
            f"v{k} AS (SELECT {cols}r, (budget - coalesce(sum(cap) OVER ({by}ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(w) OVER ({by}ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g{k})",
            f"w{k} AS (SELECT {cols}min_by(level, r) AS level FROM v{k} WHERE r > level GROUP BY {', '.join(parent) or 'ALL'})",
            f"b{k} AS (SELECT {', '.join('k.' + n for n in names[:k])}, least(k.cap::DOUBLE, coalesce(w.level * k.w, k.cap::DOUBLE)) AS budget FROM k{k} k LEFT JOIN w{k} w ON {same('k', 'w')})",
        ]
    ctes += [
        "e AS (SELECT l.*, md5(leaf) AS a, coalesce(budget, 0) AS budget FROM l LEFT JOIN b3 b ON " + " AND ".join(f"l.{n} IS NOT DISTINCT FROM b.{n}" for n in names) + ")",
        "f AS (SELECT *, floor(budget)::BIGINT AS i, floor((budget - floor(budget)) * 1e9)::BIGINT AS p FROM e)",
        "s AS (SELECT *, (sum(p) OVER (ORDER BY a, leaf ROWS UNBOUNDED PRECEDING) + 500000000)::BIGINT AS u FROM f)",
        "q AS (SELECT leaf, tokens, least(cap, i + u // 1000000000 - (u - p) // 1000000000) AS take FROM s)",
        "z AS (SELECT leaf, tokens, CASE WHEN tokens > 0 THEN take // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN take % tokens ELSE 0 END AS rest FROM q)",
        "o AS (SELECT d.*, whole, rest, sum(n) OVER (PARTITION BY leaf ORDER BY md5('7/' || whole || '/' || key) ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN z USING (leaf) WHERE rest > 0)",
        "c AS (SELECT doc_id, text, lang, source, e AS epoch, n, n AS taken FROM (SELECT d.*, unnest(range(whole)) AS e FROM d JOIN z USING (leaf)) UNION ALL SELECT doc_id, text, lang, source, whole, n, least(n, rest - upto + n) FROM o WHERE upto - n < rest)",
    ]
    cut = r"length(array_to_string(list_slice(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+'), 1, taken), ''))"
    return f"WITH {', '.join(ctes)} SELECT doc_id, lang, source, epoch::INT AS epoch, taken::BIGINT AS n_tokens, (CASE WHEN taken < n THEN {cut} ELSE length(text) END)::BIGINT AS n_chars FROM c"


SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, k, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS s FROM l),
c AS (SELECT s, len(s) AS n, min({'d': doc_id, 'k': k}) AS first, row_number() OVER () AS c FROM w WHERE len(s) >= 1 GROUP BY s),
t AS (SELECT c, n, first, unnest(s) AS t FROM c),
f AS (SELECT t, count(*) AS f FROM t GROUP BY t),
p AS (SELECT c, n, first, t, row_number() OVER (PARTITION BY c ORDER BY f, t) AS r FROM t JOIN f USING (t)),
x AS (SELECT * FROM p WHERE r <= n - (8 * n + 9) // 10 + 1),
q AS (SELECT DISTINCT x.c AS a, y.c AS b FROM x JOIN x y ON x.t = y.t AND y.first < x.first AND 10 * y.n >= 8 * x.n AND 10 * x.n >= 8 * y.n),
g AS (SELECT DISTINCT a AS c FROM q JOIN c u ON u.c = a JOIN c v ON v.c = b WHERE 9 * len(list_intersect(u.s, v.s)) >= 4 * (u.n + v.n)),
z AS (
  SELECT l.doc_id, l.k, line, c.c IS NOT NULL AND (c.first <> {'d': l.doc_id, 'k': l.k} OR g.c IS NOT NULL) AS gone
  FROM l JOIN w USING (doc_id, k) LEFT JOIN c ON c.s = w.s LEFT JOIN g ON g.c = c.c),
o AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n FROM z GROUP BY doc_id)
SELECT doc_id, length(text)::BIGINT AS kept_chars, sha256(text) AS text_sha256, n::BIGINT AS lines_removed
FROM o WHERE n = 0 OR regexp_matches(text, '[^ \t\r\n]')
UNION ALL SELECT doc_id, NULL, NULL, 0 FROM documents WHERE text IS NULL""",
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op4_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, '<|im_start|>' || replace(replace(regexp_replace(role, '([<\[])(\\*){_TAILS}', '\1\\\2\3', 'g'), '\', '\\'), chr(10), '\n')
    || chr(10) || regexp_replace(text, '([<\[])(\\*){_TAILS}', '\1\\\2\3', 'g') || '<|im_end|>' || chr(10) AS s FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(s))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""",
    "op6_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id""",
    "op9_vptree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_mixing": _mixing_sql(),
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT sha256(h) AS d, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY 1)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN octet_length(b) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(b) >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.d = sha256(h)""",
}
