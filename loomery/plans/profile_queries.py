"""Profiles, prevalence, sets and sharing over lineitem: samples are suppliers, entities parts (or orders for sets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators import prevalence as V
from loomery.operators import profiles as P
from loomery.plans.registry import query
from loomery.runtime import table

COUNTS = "c AS (SELECT l_suppkey AS sample, l_partkey AS entity, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL)"
STRICT = "u AS (SELECT l_suppkey AS sample, l_partkey AS entity, sum(l_quantity)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)"
CATEGORY = "k AS (SELECT s_suppkey AS sample, n_name AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
REGION = "g AS (SELECT s_suppkey AS sample, r_name AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SETS = f"{REGION}, e AS (SELECT l_orderkey AS entity, list_sort(list_distinct(list(category))) AS cats FROM lineitem JOIN g ON sample = l_suppkey GROUP BY 1), t AS (SELECT cats, count(*) AS n FROM e GROUP BY 1)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def profile(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    return P.counts(lines(spark, sf), "l_suppkey", "l_partkey", "l_quantity", F.col("l_returnflag") == "N" if strict else None)


def parts(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col(key).alias("length" if key == "p_size" else "key"))


def category(spark: SparkSession, sf: str) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("sample"), F.col("n_name").alias("category"))


def region(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("sample"), F.col("r_name").alias("category"))


def reached(spark: SparkSession, sf: str) -> DataFrame:
    li = lines(spark, sf).select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("entity"))
    return li.join(region(spark, sf), "sample").select("entity", "category")


@query(f"WITH {COUNTS} SELECT * FROM c")
def profile_counts(spark, sf):
    return profile(spark, sf)


@query(f"WITH {COUNTS} SELECT sample, sum(n)::BIGINT AS total, count(*) AS entities FROM c GROUP BY 1")
def sample_totals(spark, sf):
    return profile(spark, sf).groupBy("sample").agg(F.sum("n").alias("total"), F.count("*").alias("entities"))


@query(f"WITH {COUNTS}, s AS (SELECT c.*, n / p_size AS r FROM c JOIN part ON p_partkey = entity) SELECT sample, entity, n, round(r * sum(n) OVER (PARTITION BY sample) / sum(r) OVER (PARTITION BY sample), 6) AS scaled FROM s")
def profile_scaled(spark, sf):
    return P.length_scaled(profile(spark, sf), parts(spark, sf, "p_size")).select("sample", "entity", "n", F.round("scaled", 6).alias("scaled"))


@query(f"WITH {COUNTS} SELECT sample, entity, round_even(n * 1e7 / sum(n) OVER (PARTITION BY sample), 0) AS normed FROM c")
def profile_fixed_total(spark, sf):
    return P.to_total(profile(spark, sf), "n", 1e7, "normed").select("sample", "entity", "normed")


@query(f"WITH {COUNTS} SELECT sample, entity, round(n / sum(n) OVER (PARTITION BY sample), 12) AS rel FROM c")
def profile_relative(spark, sf):
    return P.relative(profile(spark, sf)).select("sample", "entity", F.round("rel", 12).alias("rel"))


@query(f"WITH {COUNTS}, r AS (SELECT *, n / sum(n) OVER (PARTITION BY sample) AS rel FROM c), m AS (SELECT *, max(rel) OVER (PARTITION BY entity) AS top FROM r) SELECT sample, entity, round(rel, 12) AS rel FROM m WHERE top >= 1e-3")
def entities_above_share(spark, sf):
    return P.max_share_filter(profile(spark, sf), 1e-3).select("sample", "entity", F.round("rel", 12).alias("rel"))


@query(f"WITH {COUNTS} SELECT sample, p_brand AS key, sum(n)::BIGINT AS n FROM c JOIN part ON p_partkey = entity GROUP BY ALL")
def family_rollup(spark, sf):
    return P.roll_up(profile(spark, sf), parts(spark, sf, "p_brand"))


@query(f"WITH {COUNTS}, m AS (SELECT p_partkey AS entity, trim(unnest(string_split(p_name, ' '))) AS key FROM part) SELECT sample, key, sum(n)::BIGINT AS n FROM c JOIN m USING (entity) GROUP BY ALL")
def multivalue_rollup(spark, sf):
    return P.roll_up_multi(profile(spark, sf), parts(spark, sf, "p_name"), " ")


@query(f"WITH {COUNTS} SELECT sample, coalesce(p_brand, '-uncharacterized-') AS key, sum(n)::BIGINT AS n FROM c LEFT JOIN part ON p_partkey = entity AND p_partkey % 7 <> 0 GROUP BY ALL")
def residual_rollup(spark, sf):
    return P.with_residual(profile(spark, sf), parts(spark, sf, "p_brand").where("entity % 7 <> 0"), "-uncharacterized-")


@query(f"WITH {COUNTS}, s AS (SELECT sample, n, entity IN (SELECT p_partkey FROM part WHERE p_size <= 10) AS in_class FROM c) SELECT sample, in_class, sum(n)::BIGINT AS total, median(n) AS mid, count(*) AS entities FROM s GROUP BY ALL")
def class_split_stats(spark, sf):
    small = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("entity"), F.lit(True).alias("hit"))
    j = profile(spark, sf).join(small, "entity", "left").withColumn("in_class", F.coalesce("hit", F.lit(False)))
    return j.groupBy("sample", "in_class").agg(F.sum("n").alias("total"), F.median("n").alias("mid"), F.count("*").alias("entities"))


@query("SELECT l_suppkey AS sample, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit_price FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING sum(l_extendedprice) / sum(l_quantity) >= 1500")
def ratio_select(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderkey").alias("l_orderkey"))
    j = lines(spark, sf).join(o, "l_orderkey").groupBy(F.col("l_suppkey").alias("sample")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("unit_price"))
    return j.dropna().where("unit_price >= 1500").withColumn("unit_price", F.round("unit_price", 6))


@query("SELECT n_name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, max(c)::BIGINT AS most FROM (SELECT n_name, c_mktsegment, count(*) OVER (PARTITION BY n_name, c_mktsegment) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def distinct_concat(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    each = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("c"))
    return each.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.max("c").alias("most"))


@query(f"WITH {COUNTS}, {CATEGORY}, j AS (SELECT * FROM c JOIN k USING (sample)) SELECT category, entity, count(DISTINCT sample) AS n_samples FROM j GROUP BY ALL UNION ALL SELECT 'all', entity, count(DISTINCT sample) FROM j GROUP BY ALL")
def prevalence_by_category(spark, sf):
    return V.prevalence(profile(spark, sf).join(category(spark, sf), "sample"))


PREV = f"WITH {COUNTS}, {CATEGORY}, j AS (SELECT * FROM c JOIN k USING (sample)), v AS (SELECT category, entity, count(DISTINCT sample) AS n FROM j GROUP BY ALL UNION ALL SELECT 'all', entity, count(DISTINCT sample) FROM j GROUP BY ALL), spine AS (SELECT category, unnest(range((SELECT max(n) FROM v) + 1))::INT AS count FROM (SELECT DISTINCT category FROM v)), h AS (SELECT s.category, s.count, count(v.entity) AS entities FROM spine s LEFT JOIN v ON v.category = s.category AND v.n = s.count GROUP BY ALL)"


@query(f"{PREV} SELECT * FROM h")
def prevalence_histogram_dense(spark, sf):
    return V.dense_histogram(V.prevalence(profile(spark, sf).join(category(spark, sf), "sample")))


@query(f"{PREV} SELECT category, count, round(sum(entities) OVER (PARTITION BY category ORDER BY count) / sum(entities) OVER (PARTITION BY category), 12) AS share, (entities - coalesce(lag(entities) OVER (PARTITION BY category ORDER BY count), 0))::BIGINT AS step FROM h")
def prevalence_cumulative(spark, sf):
    h = V.dense_histogram(V.prevalence(profile(spark, sf).join(category(spark, sf), "sample")))
    return V.cumulative_share(h).select("category", "count", F.round("share", 12).alias("share"), "step")


@query(f"WITH {COUNTS}, {CATEGORY}, j AS (SELECT entity, count(DISTINCT sample) AS n_samples FROM c GROUP BY 1) SELECT * FROM j WHERE n_samples <= 10")
def rare_entities(spark, sf):
    return V.rare(profile(spark, sf).groupBy("entity").agg(F.count("*").alias("n_samples")), 10)


@query(f"WITH {COUNTS} SELECT sample, count(DISTINCT p_brand) AS named, count(DISTINCT p_brand) + max((p_brand IS NULL)::INT) AS with_unmapped FROM c LEFT JOIN part ON p_partkey = entity AND p_partkey % 7 <> 0 GROUP BY 1")
def richness_null_counting(spark, sf):
    mapped = profile(spark, sf).join(parts(spark, sf, "p_brand").where("entity % 7 <> 0"), "entity", "left")
    return V.richness(mapped)


SEEN = "r AS (SELECT sample, entity, n / sum(n) OVER (PARTITION BY sample) AS rel FROM c)"


@query(f"WITH {COUNTS}, {CATEGORY}, {SEEN} SELECT category, entity, round(sum(rel) / count(DISTINCT sample), 12) AS mean_rel FROM r JOIN k USING (sample) GROUP BY ALL")
def mean_abundance_when_seen(spark, sf):
    return P.mean_when_seen(profile(spark, sf), category(spark, sf)).withColumn("mean_rel", F.round("mean_rel", 12))


@query(f"WITH {COUNTS}, {STRICT}, {CATEGORY}, {SEEN} SELECT category, entity, round(sum(coalesce(rel, 0)) / count(DISTINCT sample), 12) AS mean_rel FROM u LEFT JOIN r USING (sample, entity) JOIN k USING (sample) GROUP BY ALL")
def mean_abundance_strict(spark, sf):
    return P.mean_when_seen(profile(spark, sf), category(spark, sf), profile(spark, sf, True)).withColumn("mean_rel", F.round("mean_rel", 12))


@query(f"WITH {COUNTS}, {CATEGORY} SELECT category, entity, sum(n)::BIGINT AS n FROM c JOIN k USING (sample) GROUP BY ALL UNION ALL SELECT 'all', entity, sum(n)::BIGINT FROM c JOIN k USING (sample) GROUP BY ALL")
def category_sums(spark, sf):
    each = profile(spark, sf).join(category(spark, sf), "sample").groupBy("category", "entity").agg(F.sum("n").alias("n"))
    return each.unionByName(each.groupBy("entity").agg(F.sum("n").alias("n")).select(F.lit("all").alias("category"), "entity", "n"))


@query(f"WITH {COUNTS}, {STRICT} SELECT sample, round(avg((u.entity IS NOT NULL)::INT), 12) AS in_strict, count(DISTINCT p_brand) FILTER (p_size <= 10) AS small_families, count(DISTINCT p_brand) FILTER (p_size > 40) AS large_families FROM c LEFT JOIN u USING (sample, entity) JOIN part ON p_partkey = entity GROUP BY 1")
def residual_member_fraction(spark, sf):
    u = profile(spark, sf, True).select("sample", "entity", F.lit(1).alias("hit"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), "p_brand", "p_size")
    j = profile(spark, sf).join(u, ["sample", "entity"], "left").join(p, "entity")
    return j.groupBy("sample").agg(
        F.round(F.avg(F.coalesce("hit", F.lit(0))), 12).alias("in_strict"), F.count_distinct(F.when(F.col("p_size") <= 10, F.col("p_brand"))).alias("small_families"), F.count_distinct(F.when(F.col("p_size") > 40, F.col("p_brand"))).alias("large_families")
    )


@query(f"WITH {COUNTS}, {STRICT} SELECT sample, coalesce(sum(c.n), 0)::BIGINT AS raw, coalesce(sum(u.n), 0)::BIGINT AS raw_strict, round(coalesce(sum(u.n), 0) / sum(c.n), 12) AS rate FROM c FULL JOIN u USING (sample, entity) GROUP BY 1")
def mapping_rate(spark, sf):
    u = profile(spark, sf, True).withColumnRenamed("n", "m")
    j = profile(spark, sf).join(u, ["sample", "entity"], "full").na.fill(0, ["n", "m"])
    return j.groupBy("sample").agg(F.sum("n").alias("raw"), F.sum("m").alias("raw_strict"), F.round(F.sum("m") / F.sum("n"), 12).alias("rate"))


@query(f"WITH {SETS} SELECT array_to_string(cats, '|') AS cats, n FROM t")
def category_sets(spark, sf):
    return V.set_counts(V.category_sets(reached(spark, sf))).select(F.array_join("cats", "|").alias("cats"), "n")


@query(f"WITH {SETS}, x AS (SELECT unnest(cats) AS category, cats, n FROM t) SELECT category, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (len(cats) = 1), 0)::BIGINT AS only, coalesce(sum(n) FILTER (len(cats) - list_contains(cats, 'ASIA')::INT > 1), 0)::BIGINT AS multiple FROM x GROUP BY 1")
def set_marginals(spark, sf):
    return V.set_marginals(V.set_counts(V.category_sets(reached(spark, sf))), "ASIA")


@query(f"WITH {SETS}, x AS (SELECT unnest(cats) AS a, cats, n FROM t), y AS (SELECT a, unnest(cats) AS b, n FROM x) SELECT a, b, sum(n)::BIGINT AS n FROM y WHERE a < b GROUP BY ALL")
def set_pairs(spark, sf):
    return V.set_pairs(V.set_counts(V.category_sets(reached(spark, sf))))


@query(f"WITH {SETS}, x AS (SELECT unnest(cats) AS category, cats, n FROM t) SELECT category, round(1 - coalesce(sum(n) FILTER (len(cats) = 1), 0) / sum(n), 12) AS shared FROM x GROUP BY 1")
def singleton_share(spark, sf):
    return V.shared_share(V.set_counts(V.category_sets(reached(spark, sf)))).withColumn("shared", F.round("shared", 12))


@query(f"WITH {SETS} SELECT entity, array_to_string(cats, '|') AS cats FROM e WHERE len(cats) - list_contains(cats, 'ASIA')::INT > 1")
def shared_entities(spark, sf):
    return V.travellers(V.category_sets(reached(spark, sf)), "ASIA").select("entity", F.array_join("cats", "|").alias("cats"))


@query(f"WITH {SETS}, o AS (SELECT entity, category FROM (SELECT DISTINCT l_orderkey AS entity, category FROM lineitem JOIN g ON sample = l_suppkey)) SELECT DISTINCT o.category, o.entity FROM o JOIN e USING (entity) WHERE len(cats) > 1 OR cats[1] = o.category")
def subcatalogue(spark, sf):
    own = reached(spark, sf).distinct()
    s = V.category_sets(own)
    shared = own.join(s.where(F.size("cats") > 1).select("entity"), "entity", "left_semi")
    alone = s.where(F.size("cats") == 1).select("entity", F.col("cats")[0].alias("category"))
    return shared.select("category", "entity").union(alone.select("category", "entity")).distinct()


ABUND = f"{SETS}, q AS (SELECT category, l_orderkey AS entity, sum(l_quantity) AS value FROM lineitem JOIN g ON sample = l_suppkey GROUP BY ALL), z AS (SELECT category AS source, value / sum(value) OVER (PARTITION BY category) AS share, cats FROM q JOIN e USING (entity))"


@query(f"WITH {ABUND}, p AS (SELECT source, unnest(cats) AS target, share FROM z WHERE len(cats) > 1 UNION ALL SELECT source, 'unshared', share FROM z WHERE len(cats) <= 1) SELECT source, target, round(sum(share), 6) AS share FROM p GROUP BY ALL")
def flow_matrix(spark, sf):
    li = lines(spark, sf).select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("entity"), "l_quantity")
    a = li.join(region(spark, sf), "sample").groupBy("category", "entity").agg(F.sum("l_quantity").alias("value"))
    return V.flow(a, V.category_sets(reached(spark, sf))).withColumn("share", F.round("share", 6))


@query(f"WITH {SETS}, s AS (SELECT unnest(cats) AS source, cats FROM e), p AS (SELECT source, unnest(cats) AS target FROM s) SELECT source, target, count(*) AS n FROM p WHERE source <> target GROUP BY ALL UNION ALL SELECT source, 'unshared', count(*) FROM s WHERE len(cats) = 1 GROUP BY 1 UNION ALL SELECT source, 'total', count(*) FROM s GROUP BY 1")
def raw_flow_matrix(spark, sf):
    return V.raw_flow(V.category_sets(reached(spark, sf)))


@query(f"WITH {COUNTS} SELECT sample, coalesce(sum(n) FILTER (entity = 1), 0)::BIGINT AS e1, coalesce(sum(n) FILTER (entity = 2), 0)::BIGINT AS e2, coalesce(sum(n) FILTER (entity = 3), 0)::BIGINT AS e3 FROM c GROUP BY 1")
def pivot_dense(spark, sf):
    return P.dense(profile(spark, sf), [1, 2, 3]).select("sample", F.col("1").alias("e1"), F.col("2").alias("e2"), F.col("3").alias("e3"))


@query(f"WITH {COUNTS}, {STRICT}, w AS (SELECT sample, sum(c.n)::BIGINT AS raw, coalesce(sum(u.n), 0)::BIGINT AS strict FROM c LEFT JOIN u USING (sample, entity) GROUP BY 1) SELECT sample, 'raw' AS mode, raw AS total FROM w UNION ALL SELECT sample, 'strict', strict FROM w")
def melt_rates(spark, sf):
    j = profile(spark, sf).join(profile(spark, sf, True).withColumnRenamed("n", "m"), ["sample", "entity"], "left")
    w = j.groupBy("sample").agg(F.sum("n").alias("raw"), F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("strict"))
    return P.melt(w, ["sample"], ["raw", "strict"], "mode", "total")


@query("SELECT r_name, c_mktsegment, count(*) AS n, grouping(r_name, c_mktsegment)::INT AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)")
def totals_table(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query(f"WITH {COUNTS}, t AS (SELECT sample, n, row_number() OVER (PARTITION BY sample ORDER BY n DESC, entity) AS rn, sum(n) OVER (PARTITION BY sample ORDER BY n DESC, entity ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY sample) AS share FROM c) SELECT sample, min(rn) FILTER (share >= 0.5) AS half_at FROM t GROUP BY 1")
def concentration_curve(spark, sf):
    w = Window.partitionBy("sample").orderBy(F.desc("n"), "entity")
    t = profile(spark, sf).withColumn("rn", F.row_number().over(w)).withColumn("share", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy("sample")))
    return t.groupBy("sample").agg(F.min(F.when(F.col("share") >= 0.5, F.col("rn"))).cast("bigint").alias("half_at"))


@query(f"WITH {COUNTS}, {CATEGORY}, x AS (SELECT entity, CASE WHEN category IN ('CHINA', 'INDIA', 'INDONESIA', 'JAPAN', 'VIETNAM') THEN 'far' ELSE category END AS category, sum(n) AS n FROM c JOIN k USING (sample) GROUP BY ALL) SELECT entity, category, round(n / sum(n) OVER (PARTITION BY category), 12) AS share FROM x")
def regrouped_shares(spark, sf):
    n = profile(spark, sf).join(category(spark, sf), "sample").groupBy("entity", "category").agg(F.sum("n").alias("n"))
    return P.regrouped(n, dict.fromkeys(("CHINA", "INDIA", "INDONESIA", "JAPAN", "VIETNAM"), "far")).withColumn("share", F.round("share", 12))
