"""Order-dependent operators, sampling, metadata, matrices and statistics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import graph, matrix, metadata, ordered, profiles, sampling, stats
from loomery.plans.profile_queries import COUNTS, category, profile
from loomery.plans.registry import query
from loomery.runtime import Scratch, checked_broadcast, table

#: Orders of the samples in accumulation curves, and shuffles of the labels in the null of sharing.
REPEATS, SHUFFLES = 24, 32

PERMS = f"{COUNTS}, m AS (SELECT perm, sample, row_number() OVER (PARTITION BY perm ORDER BY md5(perm || ':' || sample)) AS step FROM (SELECT DISTINCT sample FROM c), range(24) r(perm)), f AS (SELECT perm, entity, min(step) AS step FROM c JOIN m USING (sample) GROUP BY ALL)"


@query("SELECT conv_id, v0, v1, count(*) AS n FROM (SELECT conv_id, role AS v0, lead(role) OVER w AS v1, lead(1) OVER w AS ok FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE ok = 1 GROUP BY ALL")
def adjacent_pairs(spark, sf):
    return ordered.adjacent(table(spark, sf, "conversations"), "conv_id", "turn", "role").groupBy("conv_id", "v0", "v1").agg(F.count("*").alias("n"))


@query("SELECT v0, v1, v2, count(*) AS n FROM (SELECT role AS v0, lead(role) OVER w AS v1, lead(role, 2) OVER w AS v2, lead(1, 2) OVER w AS ok FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE ok = 1 GROUP BY ALL")
def adjacent_triples(spark, sf):
    return ordered.adjacent(table(spark, sf, "conversations"), "conv_id", "turn", "role", 3).groupBy("v0", "v1", "v2").agg(F.count("*").alias("n"))


@query("SELECT event_type AS v0, round(sum((event_type = v1)::INT) / nullif(sum((event_type <> v1)::INT), 0), 6) AS same_to_other FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS v1 FROM events) WHERE v1 IS NOT NULL GROUP BY 1")
def pair_ratio(spark, sf):
    p = ordered.adjacent(table(spark, sf, "events"), "user_id", "ts", "event_type")
    same = F.col("v0") == F.col("v1")
    return p.groupBy("v0").agg(F.round(F.try_divide(F.sum(same.cast("int")), F.sum((~same).cast("int"))), 6).alias("same_to_other"))


@query("WITH r AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, event_type FROM r WHERE p IS NULL OR p <> event_type")
def collapsed_runs(spark, sf):
    return ordered.collapse_runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("WITH i AS (SELECT DISTINCT o_custkey AS n FROM orders), g AS (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM i) SELECT CASE WHEN min(n) = max(n) THEN 'C' || lpad(min(n)::VARCHAR, 6, '0') ELSE 'C' || lpad(min(n)::VARCHAR, 6, '0') || '-C' || lpad(max(n)::VARCHAR, 6, '0') END AS range FROM g GROUP BY g")
def id_range_compress(spark, sf):
    ids = table(spark, sf, "orders").select(F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("id"))
    return ordered.compress_ranges(ids)


@query("SELECT DISTINCT 'C' || lpad(o_custkey::VARCHAR, 6, '0') AS id FROM orders")
def id_range_expand(spark, sf):
    return ordered.expand_ranges(id_range_compress(spark, sf))


@query("WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS v, count(*) OVER w AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS lo, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS hi FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)), b AS (SELECT l_suppkey, min(v) FILTER (lo > n // 20) AS lo, max(v) FILTER (hi > n // 20) AS hi FROM r GROUP BY 1) SELECT l_suppkey, count(*) AS n, round(avg(v), 4) AS mean FROM r JOIN b USING (l_suppkey) WHERE v BETWEEN b.lo AND b.hi GROUP BY 1")
def trim_outliers(spark, sf):
    t = ordered.trim_extremes(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice")
    return t.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("WITH c AS (SELECT p_size, p_brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY ALL), t AS (SELECT p_size, min(n) AS take FROM c GROUP BY 1 HAVING count(*) = 3), r AS (SELECT p_partkey, p_size, p_brand, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY md5(p_partkey::VARCHAR)) AS k FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')) SELECT p_partkey, p_size, p_brand FROM r JOIN t USING (p_size) WHERE k <= take")
def balanced_sample(spark, sf):
    p = table(spark, sf, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"))
    return ordered.balanced_sample(p, "p_size", "p_brand", ordered.md5_order(F.col("p_partkey")), 3).select("p_partkey", "p_size", "p_brand")


@query("SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR)) AS k FROM customer) WHERE k <= 20")
def capped_sample(spark, sf):
    return ordered.capped_sample(table(spark, sf, "customer"), "c_nationkey", ordered.md5_order(F.col("c_custkey")), 20).select("c_custkey", "c_nationkey")


@query("SELECT doc_id FROM documents WHERE substr(sha256(doc_id::VARCHAR), 1, 2) = 'ff'")
def hash_sample(spark, sf):
    return sampling.hash_sample(table(spark, sf, "documents"), "doc_id", "ff").select("doc_id")


@query("WITH s AS (SELECT p_brand, p_partkey, p_retailprice, sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) / sum(p_retailprice) OVER (PARTITION BY p_brand) AS share FROM part) SELECT p_brand, p_partkey, round(share, 6) AS share, ((round(share, 9) > 0.2)::INT + (round(share, 9) > 0.4)::INT + (round(share, 9) > 0.6)::INT + (round(share, 9) > 0.8)::INT)::INT AS class FROM s")
def size_classes(spark, sf):
    r = ordered.size_classes(table(spark, sf, "part"), "p_brand", "p_retailprice", "p_partkey")
    return r.select("p_brand", "p_partkey", F.round("share", 6).alias("share"), "class")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders) SELECT o_orderkey, 'Q' || (1 + len(list_filter(e, lambda x: o_totalprice > x))) AS bin FROM orders, q")
def quintile_bins(spark, sf):
    return ordered.quantile_bins(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "bin")


@query("WITH a AS (SELECT c_custkey AS key, c_mktsegment AS value, 0 AS p FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'rich', 1 FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 'other', 2 FROM customer) SELECT key, arg_min(value, p) AS value, min(p) AS rule FROM a GROUP BY 1")
def priority_union(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "key")
    rules = (c.where("key % 3 = 0").withColumn("value", F.col("c_mktsegment")), c.where("c_acctbal > 5000").withColumn("value", F.lit("rich")), c.withColumn("value", F.lit("other")))
    return ordered.first_wins(*rules)


@query(f"WITH {COUNTS}, u AS (SELECT sample, entity, md5(sample || ':' || entity || ':' || k) AS o FROM c, lateral (SELECT unnest(range(1, n + 1)) AS k)), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY o) AS rk, count(*) OVER (PARTITION BY sample) AS t FROM u) SELECT sample, entity, count(*) AS n FROM r WHERE t >= 1000 AND rk <= 1000 GROUP BY ALL")
def rarefied_counts(spark, sf):
    return sampling.rarefied(profile(spark, sf), 1000)


@query(f"WITH {COUNTS} SELECT sample, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS shannon, count(*) AS richness FROM c GROUP BY 1")
def diversity_panel(spark, sf):
    return sampling.shannon(profile(spark, sf)).withColumn("shannon", F.round("shannon", 6))


@query(f"WITH {COUNTS}, b AS (SELECT sample, p_brand, sum(n) AS n FROM c JOIN part ON p_partkey = entity WHERE p_size <= 25 GROUP BY ALL) SELECT sample, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS shannon, count(*) AS richness FROM b GROUP BY 1")
def shannon_markers(spark, sf):
    p = table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("entity"), "p_brand")
    b = profile(spark, sf).join(p, "entity").groupBy("sample", "p_brand").agg(F.sum("n").alias("n"))
    return sampling.shannon(b).withColumn("shannon", F.round("shannon", 6))


def suppliers_of_lines(spark, sf):
    """The profile's samples and entities, without the profile: repeated rows count once there."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("entity"))


@query(f"WITH {PERMS} SELECT m.perm, m.step, count(f.entity) AS n_seen FROM m LEFT JOIN f ON f.perm = m.perm AND f.step <= m.step GROUP BY ALL")
def accumulation_curve(spark, sf):
    return sampling.accumulation(suppliers_of_lines(spark, sf), sampling.permutations(suppliers_of_lines(spark, sf), REPEATS)).select(F.col("perm").cast("bigint").alias("perm"), F.col("step").cast("bigint").alias("step"), "n_seen")


@query(f"WITH {PERMS}, v AS (SELECT entity, count(*) AS p FROM c GROUP BY 1) SELECT m.perm, m.step, t AS threshold, count(v.entity) AS n_seen FROM m CROSS JOIN (SELECT unnest([1, 10, 20]) AS t) LEFT JOIN f ON f.perm = m.perm AND f.step <= m.step LEFT JOIN v ON v.entity = f.entity AND v.p >= t GROUP BY ALL")
def accumulation_thresholds(spark, sf):
    out = sampling.accumulation_by_threshold(suppliers_of_lines(spark, sf), sampling.permutations(suppliers_of_lines(spark, sf), REPEATS), [1, 10, 20])
    return out.select(F.col("perm").cast("bigint").alias("perm"), F.col("step").cast("bigint").alias("step"), "threshold", "n_seen")


def suppliers_of_orders(spark, sf):
    """A row for each line: for smallest and largest labels repeated rows need not be found."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("entity"))


SHUFFLED = "l AS (SELECT s_suppkey AS sample, n_name AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey), a AS (SELECT r.i AS replicate, sample, row_number() OVER (PARTITION BY r.i ORDER BY sample) AS k FROM l, range(32) r(i)), b AS (SELECT r.i AS replicate, category, row_number() OVER (PARTITION BY r.i ORDER BY md5(r.i || ':' || sample)) AS k FROM l, range(32) r(i)), z AS (SELECT a.replicate, a.sample, b.category FROM a JOIN b USING (replicate, k)), o AS (SELECT DISTINCT l_suppkey AS sample, l_orderkey AS entity FROM lineitem), s AS (SELECT replicate, entity, count(DISTINCT category) AS c FROM o JOIN z USING (sample) GROUP BY ALL)"


@query(f"WITH {SHUFFLED} SELECT replicate, count(*) AS shared FROM s WHERE c > 1 GROUP BY 1")
def shuffled_sharing_null(spark, sf):
    return sampling.shared_under(suppliers_of_orders(spark, sf), sampling.shuffled_labels(category(spark, sf), SHUFFLES), SHUFFLES)


@query()
def sharing_normality(spark, sf):
    """Shapiro-Wilk over the shuffles' counts, of which there are SHUFFLES."""
    counts = [float(r["shared"]) for r in shuffled_sharing_null(spark, sf).collect()]
    w, p = stats.shapiro(counts) if len(counts) > 2 else (None, None)
    return spark.createDataFrame([(w, p, len(counts))], "w double, p double, n int")


@query(f"WITH {SHUFFLED}, r AS (SELECT replicate, count(*) AS n FROM s WHERE c > 1 GROUP BY 1), x AS (SELECT count(*) AS n FROM (SELECT entity FROM o JOIN l USING (sample) GROUP BY 1 HAVING count(DISTINCT category) > 1)) SELECT (SELECT n FROM x) AS observed, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, round(((SELECT n FROM x) - avg(n)) / nullif(stddev_samp(n), 0), 6) AS z FROM r")
def sharing_z_score(spark, sf):
    # the labels as they are go along as one more replicate
    labels = category(spark, sf)
    every = sampling.shuffled_labels(labels, SHUFFLES).unionByName(labels.withColumn("replicate", F.lit(SHUFFLES)))
    per = sampling.shared_under(suppliers_of_orders(spark, sf), every, SHUFFLES + 1)
    null, here = F.col("replicate") < SHUFFLES, F.col("replicate") == SHUFFLES
    t = per.agg(F.coalesce(F.max(F.when(here, F.col("shared"))), F.lit(0)).alias("observed"), F.avg(F.when(null, F.col("shared"))).alias("m"), F.stddev_samp(F.when(null, F.col("shared"))).alias("s"))
    return t.select("observed", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.round(F.try_divide(F.col("observed") - F.col("m"), F.col("s")), 6).alias("z"))


UNNEST = "r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_custkey || ';g' || o_custkey ELSE '' END AS fast, CASE WHEN o_orderkey % 2 = 0 THEN '1;2' END AS fast_n, 's' || o_custkey || ';t' || o_orderkey AS sub, '3;4' AS sub_n FROM orders)"


@query(f"WITH {UNNEST}, l AS (SELECT id, string_split(CASE WHEN fast = '' THEN sub ELSE fast END, ';') AS a, string_split(CASE WHEN fast = '' THEN sub_n ELSE fast_n END, ';') AS b FROM r) SELECT id, unnest(a) AS name, unnest(b) AS size FROM l")
def list_unnest_lockstep(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    even = k % 2 == 0
    r = table(spark, sf, "orders").select(k.alias("id"), F.when(even, F.concat(F.lit("f"), c, F.lit(";g"), c)).otherwise("").alias("fast"), F.when(even, "1;2").alias("fast_n"), F.concat(F.lit("s"), c, F.lit(";t"), k).alias("sub"), F.lit("3;4").alias("sub_n"))
    return metadata.unnest_lockstep(r, ["id"], {"name": ("fast", "sub"), "size": ("fast_n", "sub_n")})


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END) AS segment FROM customer")
def coalesce_conflict(spark, sf):
    a, b = (F.when(F.col("c_custkey") % k == 0, F.col("c_mktsegment")) for k in (2, 3))
    return table(spark, sf, "customer").select("c_custkey", metadata.coalesced(a, b).alias("segment"))


@query("SELECT coalesce(a.k, b.k) AS key, coalesce(b.v, a.v) AS value FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) a FULL JOIN (SELECT s_suppkey * 2 AS k, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS v FROM supplier) b ON a.k = b.k")
def overlay(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    patch = table(spark, sf, "supplier").select((F.col("s_suppkey") * 2).alias("key"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_name")).alias("value"))
    return metadata.overlay(base, patch, "key", ["value"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS half, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal END AS tenth FROM customer")
def fill_pruned_columns(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", F.when(k % 10 == 0, F.col("c_acctbal")).alias("tenth"), F.when(k == 1, F.col("c_mktsegment")).alias("one"), F.when(k % 2 == 0, F.col("c_name")).alias("half"))
    return metadata.well_filled(c, ["c_custkey"], 10)


@query("SELECT name, count(*) AS n, count(DISTINCT value) AS values FROM (SELECT unnest(json_keys(props)) AS name, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events) GROUP BY 1")
def json_props(spark, sf):
    a = metadata.attributes(table(spark, sf, "events"), "event_id", "props")
    return a.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def html_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("bigint").alias("links"))


@query("WITH p AS (SELECT n_nationkey AS k, n_nationkey * 7 - 80 AS lat, n_nationkey * 13 - 160 AS lon FROM nation), x AS (SELECT a.k AS a, b.k AS b, radians(a.lat) AS p, radians(b.lat) AS q, radians(b.lon - a.lon) AS d FROM p a JOIN p b ON a.k < b.k) SELECT a, b, round(6372800.0 * atan2(sqrt(pow(cos(q) * sin(d), 2) + pow(cos(p) * sin(q) - sin(p) * cos(q) * cos(d), 2)), sin(p) * sin(q) + cos(p) * cos(q) * cos(d)), 3) AS metres FROM x")
def great_circle_pairs(spark, sf):
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") * 7 - 80).alias("lat"), (F.col("n_nationkey") * 13 - 160).alias("lon"))
    q = p.select(F.col("a").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.crossJoin(F.broadcast(q)).where("a < b").select("a", "b", F.round(metadata.great_circle(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("metres"))


OVERLAP = "s AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS x FROM lineitem), z AS (SELECT id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY ALL)"


def overlaps(spark, sf):
    """Overlap coefficients of the suppliers' sets of parts."""
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("x")).distinct()
    # sizes are written and counted, so that pairs are not shuffled again to meet them
    n = checked_broadcast(Scratch(spark, "overlaps").keep(s.groupBy("id").agg(F.count("*").alias("n")), "sizes"))
    # a part's later suppliers go to each of its suppliers as one array, and pairs are made and counted where they arrive
    of = s.where("x IS NOT NULL").groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")).where("size(ids) > 1")
    later = of.select(F.posexplode("ids").alias("p", "a"), "ids").where("p + 1 < size(ids)").select("a", F.expr("slice(ids, p + 2, size(ids) - p - 1)").alias("bs")).repartition("a")
    m = later.select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("m"))
    return m.join(n.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("m") / F.least("na", "nb")).alias("score"))


@query(f"WITH {OVERLAP} SELECT a, b, round(m / least(x.n, y.n), 6) AS score FROM o JOIN z x ON x.id = a JOIN z y ON y.id = b")
def overlap_coefficient(spark, sf):
    return overlaps(spark, sf).withColumn("score", F.round("score", 6))


@query()
def greedy_pairing(spark, sf):
    return graph.best_pairing(overlaps(spark, sf), 0.05)


VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@query(f"WITH {VEC} SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_distance(a.e, b.e), 6) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id")
def within_category_distance(spark, sf):
    return matrix.within_category(table(spark, sf, "embeddings"), "label", "vec_id", "embedding").withColumn("d", F.round("d", 6))


def family_matrix(spark, sf):
    # lines lie by part, so that they are shuffled once to be summed by pair and to meet their part
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").repartition("l_partkey")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("feature"))
    n = profiles.counts(li, "l_suppkey", "l_partkey", "l_quantity")
    return n.join(p.hint("shuffle_hash"), "entity").groupBy(F.col("sample").alias("row"), "feature").agg(F.sum("n").cast("double").alias("value"))


FAM = f"{COUNTS}, x AS (SELECT sample AS r, p_brand AS f, sum(n)::DOUBLE AS v FROM c JOIN part ON p_partkey = entity GROUP BY ALL), k AS (SELECT DISTINCT r FROM x), w AS (SELECT r, f, coalesce(v, 0) AS v FROM (SELECT k.r, q.f FROM k, (SELECT DISTINCT f FROM x) q) LEFT JOIN x USING (r, f))"


@query(f"WITH {FAM} SELECT a.r AS a, b.r AS b, round(sum((a.v - b.v) * (a.v - b.v)), 4) AS d FROM w a JOIN w b ON a.f = b.f AND a.r < b.r GROUP BY ALL")
def sq_distance_matrix(spark, sf):
    return matrix.pairwise(family_matrix(spark, sf)).withColumn("d", matrix.rounded("d", 4))


@query(f"WITH {FAM} SELECT a.r AS a, b.r AS b, round(sum(abs(a.v - b.v)), 4) AS d FROM w a JOIN w b ON a.f = b.f AND a.r < b.r GROUP BY ALL")
def city_block(spark, sf):
    return matrix.pairwise(family_matrix(spark, sf), "city").withColumn("d", matrix.rounded("d", 4))


@query()
def pcoa(spark, sf):
    # the distances of city_block, between rows that differ: equal ones share their coordinates
    of, kinds = matrix.alike(family_matrix(spark, sf))
    long = kinds.select(F.col("first").alias("row"), F.inline_outer("cells"))
    d = matrix.pairwise(long, "city").withColumn("d", matrix.rounded("d", 4))
    names, at, share = matrix.principal_coordinates(d, times=kinds.select(F.col("first").alias("row"), "n"))
    points = [(int(n), int(k), float(at[i, k]), float(share[k])) for i, n in enumerate(names) for k in range(at.shape[1])]
    return of.join(spark.createDataFrame(points, "first bigint, axis int, coordinate double, explained double"), "first").drop("first")


@query()
def pca(spark, sf):
    mean, axes = matrix.principal_components(table(spark, sf, "embeddings"), "embedding")
    centred = lambda i: F.col("embedding")[i].cast("double") - float(mean[i])
    project = lambda k: sum((centred(i) * float(axes[i, k]) for i in range(1, len(mean))), centred(0) * float(axes[0, k]))
    return table(spark, sf, "embeddings").select("vec_id", project(0).alias("pc1"), project(1).alias("pc2"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 9) AS r, count(*) AS n FROM lineitem")
def pearson(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("r"), F.count("*").alias("n"))


RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"SELECT round(corr(a, b), 6) AS rho FROM (SELECT {RANK.format('l_quantity')} AS a, {RANK.format('l_discount')} AS b FROM lineitem)")
def spearman(spark, sf):
    return stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_discount").withColumn("rho", F.round("rho", 6))


@query(f"WITH r AS (SELECT lang, {RANK.format('n_chars')} AS r FROM documents), g AS (SELECT lang, sum(r) AS s, count(*)::DOUBLE AS n FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM documents GROUP BY n_chars)), q AS (SELECT sum(s * s / n) AS q, sum(n) AS n, (count(*) - 1)::BIGINT AS df FROM g) SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) AS h, df FROM q, t")
def kruskal_h(spark, sf):
    return stats.kruskal(table(spark, sf, "documents"), "lang", "n_chars").withColumn("h", F.round("h", 5))


@query(f"WITH r AS (SELECT quality = 1 AS f, {RANK.format('n_chars')} AS r FROM documents JOIN labels USING (doc_id)), s AS (SELECT sum(r) FILTER (f) AS s, (count(*) FILTER (f))::DOUBLE AS a, (count(*) FILTER (NOT f))::DOUBLE AS b FROM r), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM documents JOIN labels USING (doc_id) GROUP BY n_chars)), u AS (SELECT s - a * (a + 1) / 2 AS u, a, b, a + b AS n, ties FROM s, t) SELECT round(u, 1) AS u, round((u - a * b / 2) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u")
def mannwhitney_u(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return stats.mann_whitney(j, F.col("quality") == 1, "n_chars").select(F.round("u", 1).alias("u"), F.round("z", 6).alias("z"))


@query("SELECT tt, tf, ft, ff, round(tt * ff / nullif(tf * ft, 0), 6) AS odds FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tt, count(*) FILTER (quality = 1 AND toxic = 0) AS tf, count(*) FILTER (quality = 0 AND toxic = 1) AS ft, count(*) FILTER (quality = 0 AND toxic = 0) AS ff FROM labels)")
def fisher_or(spark, sf):
    return stats.contingency(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1).withColumn("odds", F.round("odds", 6))


@query(f"WITH {PERMS}, a AS (SELECT m.perm, m.step, count(f.entity) AS n FROM m LEFT JOIN f ON f.perm = m.perm AND f.step <= m.step GROUP BY ALL) SELECT perm, round(regr_slope(ln(n), ln(step)), 6) AS slope, round(regr_intercept(ln(n), ln(step)), 6) AS intercept FROM a WHERE n > 0 GROUP BY 1")
def loglog_fit(spark, sf):
    return stats.log_log_fit(accumulation_curve(spark, sf), "step", "n_seen", "perm").select("perm", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query()
def forest_cv(spark, sf):
    return stats.forest_cv(table(spark, sf, "embeddings"), "embedding", "label", "vec_id")


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, min(p_retailprice) AS lo, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(median(p_retailprice), 6) AS mid, round(quantile_cont(p_retailprice, 0.75), 6) AS q3, max(p_retailprice) AS hi, round(1.96 * stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS band FROM part GROUP BY 1")
def describe_groups(spark, sf):
    v = F.col("p_retailprice")
    return table(spark, sf, "part").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.min(v).alias("lo"), F.round(F.percentile(v, 0.25), 6).alias("q1"), F.round(F.median(v), 6).alias("mid"), F.round(F.percentile(v, 0.75), 6).alias("q3"), F.max(v).alias("hi"), F.round(1.96 * F.stddev_samp(v) / F.sqrt(F.count("*")), 6).alias("band")
    )


@query("SELECT 'CUST.' || substr(lpad(c::VARCHAR, 9, '0'), 1, 3) || '_' || substr(lpad(c::VARCHAR, 9, '0'), 4, 3) || '_' || substr(lpad(c::VARCHAR, 9, '0'), 7, 3) || '.' || CASE WHEN length(seg) > 10 THEN 'UNKNOWN' ELSE seg END AS public_id, c AS ordinal FROM (SELECT c_custkey AS c, c_mktsegment AS seg FROM customer)")
def public_ids(spark, sf):
    d = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    short = F.when(F.col("c_mktsegment").isNull() | (F.length("c_mktsegment") > 10), "UNKNOWN").otherwise(F.col("c_mktsegment"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("CUST."), F.substring(d, 1, 3), F.lit("_"), F.substring(d, 4, 3), F.lit("_"), F.substring(d, 7, 3), F.lit("."), short).alias("public_id"))
    return c.select("public_id", F.replace(F.split_part("public_id", F.lit("."), F.lit(2)), F.lit("_"), F.lit("")).cast("bigint").alias("ordinal"))


@query("SELECT doc_id, round((length(text) - length(replace(replace(text, 'e', ''), 'a', ''))) / (length(text) + 1), 12) AS share FROM documents")
def letter_share(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").select("doc_id", F.round((n - F.length(F.translate("text", "ea", ""))) / (n + 1), 12).alias("share"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS quality FROM orders")
def quality_classes(spark, sf):
    v = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.when(v > 200000, "high").when(v > 100000, "medium").otherwise("low").alias("quality"))
