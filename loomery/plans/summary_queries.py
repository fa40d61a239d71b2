"""Summaries over annotations, alignments and memberships."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import ordered, summaries
from loomery.plans.profile_queries import REGION, region
from loomery.plans.registry import query
from loomery.runtime import table


@query("SELECT count(DISTINCT l_orderkey) AS queries, count(DISTINCT CASE WHEN l_orderkey <> l_partkey THEN l_orderkey END) AS with_hit, count(DISTINCT CASE WHEN l_orderkey <> l_partkey AND l_quantity * 2 >= 90 THEN l_orderkey END) AS at_90, count(DISTINCT CASE WHEN l_orderkey <> l_partkey AND l_quantity * 2 >= 92 THEN l_orderkey END) AS at_92, count(DISTINCT CASE WHEN l_orderkey <> l_partkey AND l_quantity * 2 >= 95 THEN l_orderkey END) AS at_95 FROM lineitem")
def alignment_stats(spark, sf):
    return summaries.identity_cascade(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qseqid"), F.col("l_partkey").alias("sseqid"), (F.col("l_quantity") * 2).alias("pident")))


@query("SELECT b.item_id AS query, d.doc_id AS id, substr(d.text, 1 + b.item_id % 7, 20) AS part FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3")
def interval_extract(spark, sf):
    i = F.col("item_id")
    h = table(spark, sf, "benchmark").select(i.alias("query"), (i * 3).alias("id"), (1 + i % 7).cast("int").alias("start"), (20 + i % 7).cast("int").alias("end"))
    return summaries.extract(h, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq")))


@query("WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_partkey % 30 AS a_start, l_suppkey % 30 AS b_start, 60 + l_partkey % 40 AS a_end, 60 + l_suppkey % 40 AS b_end, 100 AS a_len, 100 AS b_len FROM lineitem) SELECT k, n, p, s FROM a WHERE ((a_len - a_end - 1 <= 5 AND b_start <= 5) OR (b_len - b_end - 1 <= 5 AND a_start <= 5)) AND NOT ((a_start = 0 AND a_end + 1 = a_len) OR (b_start = 0 AND b_end + 1 = b_len))")
def end_overlaps(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), p.alias("p"), s.alias("s"), (p % 30).alias("a_start"), (s % 30).alias("b_start"), (60 + p % 40).alias("a_end"), (60 + s % 40).alias("b_end"), F.lit(100).alias("a_len"), F.lit(100).alias("b_len"))
    return a.where(summaries.ends_overlap()).select("k", "n", "p", "s")


LANES = "l AS (SELECT l_suppkey AS sample, l_orderkey || '-' || l_linenumber AS lane, CASE l_linenumber % 4 WHEN 0 THEN 'raw_1.fastq.gz' WHEN 1 THEN 'preproc.lno8.pairs.1' WHEN 2 THEN 'preproc.lno8.pairs.2' ELSE 'preproc.lno8.singles' END AS file, l_partkey AS n, l_quantity::BIGINT * 100 AS b FROM lineitem), m AS (SELECT sample, lane, max(file) AS file, max(n) AS n, max(b) AS b FROM l GROUP BY ALL)"


@query(f"WITH {LANES} SELECT sample, coalesce(sum(n) FILTER (file LIKE '%pairs.1' OR file LIKE '%singles'), 0)::BIGINT AS inserts, coalesce(sum(b) FILTER (file LIKE 'preproc%'), 0)::BIGINT AS bases, coalesce(sum(b) FILTER (file NOT LIKE 'preproc%'), 0)::BIGINT AS bases_before FROM m GROUP BY 1")
def qc_rollup(spark, sf):
    k = F.col("l_linenumber") % 4
    file = F.when(k == 0, "raw_1.fastq.gz").when(k == 1, "preproc.lno8.pairs.1").when(k == 2, "preproc.lno8.pairs.2").otherwise("preproc.lno8.singles")
    lane = F.concat_ws("-", "l_orderkey", "l_linenumber")
    stat = lambda name, value: F.struct(F.concat(lane, F.lit(f":{name}")).alias("key"), value.cast("string").alias("value"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.explode(F.array(stat("file", file), stat("numSeqs", F.col("l_partkey")), stat("numBasepairs", F.col("l_quantity").cast("bigint") * 100))).alias("s"))
    return summaries.qc_rollup(rows.select("sample", "s.*"))


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(summaries.weighted_mean("l_discount", "l_quantity"), 9).alias("mean"))


@query("SELECT l_partkey, round(count(DISTINCT l_suppkey)::DOUBLE / (SELECT count(DISTINCT l_suppkey) FROM lineitem), 12) AS share FROM lineitem GROUP BY 1")
def relative_frequency(spark, sf):
    return summaries.relative_frequency(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey").withColumn("share", F.round("share", 12))


@query("WITH o AS (SELECT doc_id AS entity, lang AS category FROM documents), c AS (SELECT x.doc_id AS entity, y.lang AS category FROM documents x JOIN documents y ON x.text = y.text) SELECT category, count(*) AS n FROM (SELECT * FROM o UNION SELECT * FROM c) GROUP BY 1")
def credited_copies(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("entity"), F.col("lang").alias("category"), F.sha2("text", 256).alias("h"))
    langs = d.select("h", "category").distinct()
    return summaries.credited(d.select("entity", "category"), d.select("entity", "h").join(langs, "h").select("entity", "category"))


@query("WITH p AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY text) AS b FROM documents), l AS (SELECT doc_id AS k, quality AS v FROM labels) SELECT count(*) AS pairs, round(avg((x.v IS DISTINCT FROM y.v)::INT), 12) AS differ FROM p LEFT JOIN l x ON x.k = a LEFT JOIN l y ON y.k = b WHERE a <> b")
def annotation_disagreement(spark, sf):
    from loomery.operators.dedup import duplicate_relations

    p = duplicate_relations(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    out = summaries.disagreement(p, table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label")))
    return out.withColumn("differ", F.round("differ", 12))


@query(f"WITH {REGION}, m AS (SELECT l_partkey AS entity, category, count(*) AS n FROM lineitem JOIN g ON sample = l_suppkey GROUP BY ALL) SELECT entity, max(CASE WHEN category = 'ASIA' THEN CASE WHEN n >= 5 THEN 2 ELSE 1 END ELSE 0 END) AS asia, max(CASE WHEN category = 'EUROPE' THEN CASE WHEN n >= 5 THEN 2 ELSE 1 END ELSE 0 END) AS europe FROM m WHERE category IN ('ASIA', 'EUROPE') GROUP BY 1")
def membership_matrix(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("entity"))
    m = li.join(region(spark, sf), "sample").where(F.col("category").isin("ASIA", "EUROPE"))
    return summaries.membership(m, ["ASIA", "EUROPE"], 5).select("entity", F.col("ASIA").alias("asia"), F.col("EUROPE").alias("europe"))


@query(f"WITH {REGION}, s AS (SELECT l_orderkey AS entity, list_sort(list_distinct(list(category))) AS c FROM lineitem JOIN g ON sample = l_suppkey GROUP BY 1) SELECT entity, CASE WHEN c = ['ASIA'] THEN 'isolate' WHEN list_contains(c, 'ASIA') THEN 'mixed' ELSE 'meta' END AS tag, coalesce(array_to_string(list_filter(c, lambda x: x <> 'ASIA'), ','), '') AS cats FROM s")
def origin_tags(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("entity"))
    return summaries.origin_tag(li.join(region(spark, sf), "sample"), "ASIA")


@query("SELECT c_custkey, round(coalesce(v, (SELECT avg(v) FROM (SELECT CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS v FROM customer))), 6) AS v FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS v FROM customer)")
def mean_imputed(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("v"))
    return summaries.imputed(c, "v").select("c_custkey", F.round("v", 6).alias("v"))


@query("SELECT l_suppkey, round(avg(l_extendedprice / l_quantity), 6) AS ratio, count(*) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 HAVING count(*) >= 5")
def guarded_ratios(spark, sf):
    return summaries.ratio_rows(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice", 10, 5).withColumn("ratio", F.round("ratio", 6))


@query("SELECT p_partkey, 'B' || substr(d, 1, 3) || '_' || substr(d, 4, 3) AS new_id FROM (SELECT p_partkey, lpad((row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) - 1)::VARCHAR, 6, '0') AS d FROM part)")
def rank_renumber(spark, sf):
    p = table(spark, sf, "part")
    return summaries.renumbered(p, [F.desc("p_partkey")], "B", F.col("p_size")).select("p_partkey", "new_id")


@query("SELECT p_partkey, replace(replace(p_name, ' ', '-'), 'green', 'verde') AS name FROM part")
def composite_rename(spark, sf):
    names = F.create_map(F.lit("green"), F.lit("verde"))
    v = F.replace("p_name", F.lit(" "), F.lit("-"))
    return table(spark, sf, "part").select("p_partkey", summaries.renamed_parts(v, names).alias("name"))


@query("SELECT o_orderkey FROM orders WHERE md5(o_orderkey::VARCHAR) < '028f5c28f5c28f5c28f5c28f5c28f5c2'")
def bernoulli_sample(spark, sf):
    # the first hex digits below a hundredth of their range
    return table(spark, sf, "orders").where(ordered.md5_order(F.col("o_orderkey")) < "028f5c28f5c28f5c28f5c28f5c28f5c2").select("o_orderkey")
