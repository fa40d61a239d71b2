"""One query for each inventoried operator that no other query goes through: joins, sets, order, text and formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators import metadata, ordered, profiles, relations, sampling
from loomery.plans.profile_queries import CATEGORY, COUNTS, REGION, category, profile, region
from loomery.plans.registry import query
from loomery.runtime import Scratch, table


@query("WITH n AS (SELECT c_name AS name, row_number() OVER (ORDER BY c_name) - 1 AS i FROM (SELECT DISTINCT c_name FROM customer)) SELECT c.c_custkey, a.i AS a_ix, b.i AS b_ix FROM customer c JOIN customer d ON d.c_custkey = c.c_custkey + 1 JOIN n a ON a.name = c.c_name JOIN n b ON b.name = d.c_name")
def encoded_edges(spark, sf):
    """Names to ordinals at both ends of edges."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("a"))
    names = c.select(F.col("a").alias("name")).distinct()
    # ordinals in order of names: rows of smaller first letters, then places among equal ones
    names = names.withColumn("ordinal", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")) - 1).cast("bigint"))
    edges = c.join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("a").alias("b")), "c_custkey")
    return relations.encode_ends(edges, names, "a", "b").select("c_custkey", "a_ix", "b_ix")


@query("SELECT p_partkey AS key, p_brand AS name, 'own' AS kind FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_linenumber = 1 UNION SELECT p_partkey, p_type, 'other' FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_linenumber = 2")
def joined_columns(spark, sf):
    """The union of two joins, columns projected and a constant beside them."""
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    one = lambda n, c, kind: p.join(li.where(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select(F.col("p_partkey").alias("key"), F.col(c).alias("name"), F.lit(kind).alias("kind"))
    return one(1, "p_brand", "own").unionByName(one(2, "p_type", "other")).distinct()


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def only_first(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key")).join(table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("key")), "key", "left_anti").distinct()


@query("SELECT n_name, coalesce(n, 0)::BIGINT AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey")
def reindexed(spark, sf):
    """Counts brought to a spine of names, zeros filled in."""
    c = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "nation").join(c, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("SELECT chunk, r_name AS base FROM range(4) x(chunk), region")
def chunk_pairs(spark, sf):
    """Every chunk of a fixed few with every base."""
    return table(spark, sf, "region").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("chunk"), F.col("r_name").alias("base"))


@query("SELECT count(*) FILTER (p_partkey IS NOT NULL) AS found, count(*) FILTER (p_partkey IS NULL) AS missing FROM (SELECT DISTINCT l_partkey + 50 AS k FROM lineitem) LEFT JOIN part ON p_partkey = k")
def selected_keys(spark, sf):
    """How many asked-for keys a table has and how many it lacks."""
    k = table(spark, sf, "lineitem").select((F.col("l_partkey") + 50).alias("p_partkey")).distinct()
    j = k.join(table(spark, sf, "part").select("p_partkey", F.lit(1).alias("hit")), "p_partkey", "left")
    return j.agg(F.count("hit").alias("found"), F.count_if(F.col("hit").isNull()).alias("missing"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) + (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS equal")
def equal_index(spark, sf):
    """Whether two tables have the same keys."""
    a, b = (table(spark, sf, t).select("doc_id").distinct() for t in ("documents", "labels"))
    j = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "doc_id", "full")
    return j.agg((F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0).alias("equal"))


@query("SELECT p_brand, max(p_size) AS size, max(p_retailprice) AS price, max(p_type) AS type, arg_min(p_name, p_partkey) AS first FROM part GROUP BY 1")
def group_max_first(spark, sf):
    """The largest value of every column, and the first row's name, of each group."""
    return table(spark, sf, "part").groupBy("p_brand").agg(F.max("p_size").alias("size"), F.max("p_retailprice").alias("price"), F.max("p_type").alias("type"), F.min_by("p_name", "p_partkey").alias("first"))


@query("SELECT c_mktsegment, row_number() OVER (ORDER BY m DESC, c_mktsegment) AS place FROM (SELECT c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY 1)")
def ordered_groups(spark, sf):
    """Groups in order of their medians."""
    m = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("m"))
    return m.select("c_mktsegment", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("m"), "c_mktsegment")).cast("bigint").alias("place"))


@query("SELECT l_suppkey AS sample, CASE WHEN o_orderkey IS NULL THEN l_suppkey || '-unbinned' ELSE 'bin-' || o_custkey END AS bin, count(*) AS n FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' GROUP BY ALL")
def bin_counts(spark, sf):
    """Genes by the bin that holds their contig, what is in none under its sample's own label."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    j = table(spark, sf, "lineitem").join(o, "l_orderkey", "left")
    bin_ = F.when(F.col("o_custkey").isNull(), F.concat(F.col("l_suppkey").cast("string"), F.lit("-unbinned"))).otherwise(F.concat(F.lit("bin-"), "o_custkey"))
    return j.groupBy(F.col("l_suppkey").alias("sample"), bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, coalesce(max(p_type), '-') AS type, coalesce(max(p_brand), '-') AS brand FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 GROUP BY ALL")
def classified_rows(spark, sf):
    """Classification columns attached, a dash where there is none."""
    p = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return table(spark, sf, "lineitem").join(p, "l_partkey", "left").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.coalesce(F.max("p_type"), F.lit("-")).alias("type"), F.coalesce(F.max("p_brand"), F.lit("-")).alias("brand"))


ANNOTATED = f"{REGION}, a AS (SELECT l_orderkey AS entity, min(l_suppkey) AS own, list_distinct(list(category)) AS cats FROM lineitem JOIN g ON sample = l_suppkey WHERE l_orderkey % 3 = 0 GROUP BY 1), x AS (SELECT entity, unnest(cats) AS category FROM a WHERE len(cats) > 1 UNION ALL SELECT entity, category FROM a JOIN g ON sample = own WHERE len(cats) = 1)"


@query(f"WITH {ANNOTATED} SELECT category, count(*) AS n FROM x GROUP BY 1")
def annotated_by_category(spark, sf):
    """Annotated entities: shared ones count for all their categories, the others for their own sample's."""
    li = table(spark, sf, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("entity"), F.col("l_suppkey").alias("sample"))
    g = region(spark, sf)
    a = li.join(g, "sample").groupBy("entity").agg(F.min("sample").alias("sample"), F.collect_set("category").alias("cats"))
    own = a.where(F.size("cats") == 1).select("entity", "sample").join(g, "sample").select("entity", "category")
    return a.where(F.size("cats") > 1).select("entity", F.explode("cats").alias("category")).unionByName(own).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS letters, max(length(text))::BIGINT AS longest FROM documents GROUP BY 1")
def sequence_lengths(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("letters"), F.max(F.length("text").cast("bigint")).alias("longest"))


@query("WITH c AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500), s AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT n_name, n_nationkey IN (SELECT k FROM c) AS a, n_nationkey IN (SELECT k FROM s) AS b, n_nationkey IN (SELECT k FROM c) OR n_nationkey IN (SELECT k FROM s) AS any_, n_nationkey IN (SELECT k FROM c) AND n_nationkey IN (SELECT k FROM s) AS both_ FROM nation")
def membership_any_all(spark, sf):
    """Membership in two sets, in any and in both."""
    mark = lambda t, where, k, c: table(spark, sf, t).where(where).select(F.col(k).alias("n_nationkey"), F.lit(True).alias(c)).distinct()
    j = table(spark, sf, "nation").join(mark("customer", "c_acctbal > 9500", "c_nationkey", "a"), "n_nationkey", "left").join(mark("supplier", "s_acctbal > 5000", "s_nationkey", "b"), "n_nationkey", "left").na.fill(False)
    return j.select("n_name", "a", "b", (F.col("a") | F.col("b")).alias("any_"), (F.col("a") & F.col("b")).alias("both_"))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both_, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS first_only, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS second_only")
def set_table(spark, sf):
    """Union, intersection and differences of two key sets, out of one pass over both."""
    li = table(spark, sf, "lineitem").where("l_returnflag IN ('R', 'A')")
    k = li.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "A").alias("b"))
    a, b = F.col("a"), F.col("b")
    return k.agg(F.count("*").alias("either"), F.count_if(a & b).alias("both_"), F.count_if(a & ~b).alias("first_only"), F.count_if(b & ~a).alias("second_only"))


@query("SELECT c_custkey AS key, c_name AS name, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def stacked(spark, sf):
    one = lambda t, k, n: table(spark, sf, t).select(F.col(k).alias("key"), F.col(n).alias("name"), F.lit(t).alias("source"))
    return one("customer", "c_custkey", "c_name").unionByName(one("supplier", "s_suppkey", "s_name"))


@query("SELECT DISTINCT o_custkey AS key, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def first_by_key(spark, sf):
    """One row a key; rows of one key that differ would be an error."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return metadata.unique_or_fail(table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).join(c, "key"), "key")


@query("SELECT event_id FROM events ORDER BY md5('7:' || event_id) LIMIT 100")
def shuffled_head(spark, sf):
    """The first hundred of a shuffled table."""
    return table(spark, sf, "events").orderBy(ordered.md5_order(F.lit(7), F.col("event_id"))).limit(100).select("event_id")


@query("SELECT l_suppkey, CASE WHEN abs(a) >= abs(b) THEN 'l_discount' ELSE 'l_tax' END AS most, round(greatest(abs(a), abs(b)), 9) AS r FROM (SELECT l_suppkey, corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b FROM lineitem GROUP BY 1 HAVING count(*) > 5)")
def most_correlated(spark, sf):
    """The column that correlates most with another one, in size."""
    r = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.abs(F.corr("l_quantity", "l_discount")).alias("a"), F.abs(F.corr("l_quantity", "l_tax")).alias("b"), F.count("*").alias("n")).where("n > 5")
    return r.select("l_suppkey", F.when(F.col("a") >= F.col("b"), "l_discount").otherwise("l_tax").alias("most"), F.round(F.greatest("a", "b"), 9).alias("r"))


PROJECTED = f"{COUNTS}, z AS (SELECT DISTINCT sample, p_brand AS entity FROM c JOIN part ON p_partkey = entity), m AS (SELECT perm, sample, row_number() OVER (PARTITION BY perm ORDER BY md5(perm || ':' || sample)) AS step FROM (SELECT DISTINCT sample FROM z), range(2) r(perm)), f AS (SELECT perm, entity, min(step) AS step FROM z JOIN m USING (sample) GROUP BY ALL)"


@query(f"WITH {PROJECTED} SELECT perm, 0::BIGINT AS step, 0::BIGINT AS n_seen FROM range(2) r(perm) UNION ALL SELECT m.perm, m.step, count(f.entity) FROM m LEFT JOIN f ON f.perm = m.perm AND f.step <= m.step GROUP BY ALL")
def projected_curve(spark, sf):
    """An accumulation curve of the clusters that entities map to, from zero on."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("to"))
    z = profile(spark, sf).join(p, "entity").select("sample", F.col("to").alias("entity")).distinct()
    out = sampling.accumulation(z, sampling.permutations(z, 2)).select(F.col("perm").cast("bigint").alias("perm"), F.col("step").cast("bigint").alias("step"), "n_seen")
    return out.unionByName(spark.range(2).select(F.col("id").alias("perm"), F.lit(0).cast("bigint").alias("step"), F.lit(0).cast("bigint").alias("n_seen")))


@query("SELECT 'by name' AS how, c_custkey FROM customer WHERE c_name = (SELECT min(c_name) FROM customer) UNION ALL SELECT 'by key', c_custkey FROM customer WHERE c_custkey = 7")
def parameterised_lookup(spark, sf):
    """SELECTs with named parameters."""
    c = table(spark, sf, "customer")
    name = c.agg(F.min("c_name")).first()[0]
    one = lambda how, sql, **args: spark.sql(sql, args=args, c=c).select(F.lit(how).alias("how"), "c_custkey")
    return one("by name", "SELECT c_custkey FROM {c} WHERE c_name = :name", name=name).unionByName(one("by key", "SELECT c_custkey FROM {c} WHERE c_custkey = :key", key=7))


@query("SELECT n_nationkey || chr(9) || n_name AS value FROM nation UNION ALL SELECT r_regionkey || chr(9) || r_name FROM region")
def merged_files(spark, sf):
    """Files put together, the header that each begins with skipped; written by the committing writer."""
    at = Scratch(spark, "sources").path("merged")
    head = spark.createDataFrame([("#key\tname",)], "value string")
    for name, t, k, n in (("a", "nation", "n_nationkey", "n_name"), ("b", "region", "r_regionkey", "r_name")):
        head.unionByName(table(spark, sf, t).select(F.concat_ws("\t", k, n).alias("value"))).coalesce(1).write.text(f"{at}/{name}")
    return spark.read.text(f"{at}/*").where(~F.startswith("value", F.lit("#")))


@query("SELECT count(*) FILTER (length(text) >= 100) AS passed, count(*) FILTER (length(text) < 100 OR text IS NULL) AS aside FROM documents")
def teed(spark, sf):
    """A stream that passes on while what it drops goes to a table beside it, both off one written table."""
    scratch = Scratch(spark, "teed")
    rows = scratch.keep(table(spark, sf, "documents").select("doc_id", F.coalesce(F.length("text") >= 100, F.lit(False)).alias("ok")), "rows")
    return rows.where("ok").agg(F.count("*").alias("passed")).crossJoin(F.broadcast(rows.where("not ok").agg(F.count("*").alias("aside"))))


@query("SELECT '# made by a writer' AS value, 0 AS part UNION ALL SELECT '#key' || chr(9) || 'label', 1 UNION ALL SELECT r_regionkey || chr(9) || r_name, 2 FROM region")
def commented_export(spark, sf):
    """A table as text under a comment line and its columns' new names."""
    r = table(spark, sf, "region").select("r_regionkey", "r_name").toDF("key", "label")
    head = spark.createDataFrame([("# made by a writer", 0), ("#" + "\t".join(r.columns), 1)], "value string, part int")
    return head.unionByName(r.select(F.concat_ws("\t", *r.columns).alias("value"), F.lit(2).alias("part")))


@query("SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def vectors_round_trip(spark, sf):
    """Arrays through a columnar file and back."""
    v = Scratch(spark, "vectors").keep(table(spark, sf, "embeddings").select("vec_id", "embedding"), "columnar")
    return v.select("vec_id", F.size("embedding").alias("n"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT n_nationkey AS k, (n_nationkey * 7 - 80)::DOUBLE AS lat, (n_nationkey * 13 - 160)::DOUBLE AS lon, round(n_nationkey + 0.25 + 30 / 3600.0, 9) * (CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END) AS dms FROM nation")
def coordinates(spark, sf):
    """Degrees written with hemisphere letters and read back; degrees, minutes and seconds."""
    k = F.col("n_nationkey")
    n = table(spark, sf, "nation").select(k.alias("k"), metadata.hemisphere((k * 7 - 80).cast("double"), "N", "S").alias("lat"), metadata.hemisphere((k * 13 - 160).cast("double"), "E", "W").alias("lon"), F.concat(k.cast("string"), F.lit("d15m30s"), F.when(k % 2 == 0, "N").otherwise("S")).alias("dms"))
    return n.select("k", metadata.coordinate(F.col("lat")).alias("lat"), metadata.coordinate(F.col("lon")).alias("lon"), F.round(metadata.coordinate(F.col("dms")), 9).alias("dms"))


@query("SELECT o_orderkey AS k, round(log10(o_totalprice + 1e-6), 9) AS l10, round(ln(o_totalprice), 9) AS l, round(exp(o_totalprice / 1e6), 9) AS e, CASE WHEN o_orderpriority NOT IN ('1-URGENT') THEN o_orderpriority END AS priority, list_filter(string_split(o_orderpriority, '-'), lambda x: x <> '')[-1] AS field, upper(substr(o_orderpriority, 3)) AS tail, md5(o_orderkey::VARCHAR) AS m, sha256(o_orderkey::VARCHAR) AS s, year(o_orderdate)::INT AS y, dayofyear(o_orderdate)::INT AS d FROM orders")
def scalar_panel(spark, sf):
    """Logarithms, placeholders, field pickers, digests and dates."""
    v, p, k = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.round(F.log10(v + 1e-6), 9).alias("l10"), F.round(F.ln(v), 9).alias("l"), F.round(F.exp(v / 1e6), 9).alias("e"), metadata.without_placeholders(p, ("1-URGENT",)).alias("priority"),
        F.element_at(F.filter(F.split(p, "-"), lambda x: x != ""), -1).alias("field"), F.upper(F.substring(p, 3, 99)).alias("tail"), F.md5(k).alias("m"), F.sha2(k, 256).alias("s"), F.year("o_orderdate").alias("y"), F.dayofyear("o_orderdate").alias("d"),
    )


@query(f"WITH {COUNTS}, {CATEGORY}, r AS (SELECT category, p_brand AS f, sum(n)::DOUBLE AS n FROM c JOIN k USING (sample) JOIN part ON p_partkey = entity GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY category) AS rel FROM r), m AS (SELECT *, max(rel) OVER (PARTITION BY f) AS top FROM s) SELECT category, f, round(n / sum(n) OVER (PARTITION BY category), 9) AS share FROM m WHERE top > 0.045")
def filtered_rows(spark, sf):
    """Rows normalised again after features whose largest share is small are gone."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("f"))
    r = profile(spark, sf).join(category(spark, sf), "sample").join(p, "entity").groupBy("category", "f").agg(F.sum("n").cast("double").alias("n"))
    whole, each = Window.partitionBy("category"), Window.partitionBy("f")
    kept = r.withColumn("rel", F.col("n") / F.sum("n").over(whole)).withColumn("top", F.max("rel").over(each)).where("top > 0.045")
    return kept.select("category", "f", F.round(F.col("n") / F.sum("n").over(whole), 9).alias("share"))


@query(f"WITH {COUNTS}, m AS (SELECT sample, p_size % 10 AS marker, count(*) AS n FROM c JOIN part ON p_partkey = entity WHERE n > 30 GROUP BY ALL) SELECT sample, round(sum(n) / 10.0, 9) AS species FROM m GROUP BY 1")
def marker_means(spark, sf):
    """Mean count over ten marker columns of each sample, absent ones being zero."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), (F.col("p_size") % 10).alias("marker"))
    return profile(spark, sf).where("n > 30").join(p, "entity").groupBy("sample").agg(F.round(F.count("*") / 10.0, 9).alias("species"))


@query("SELECT r_name, n_name, n, (sum(n) OVER (ORDER BY r_name, n DESC, n_name ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS left_edge FROM (SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)")
def rank_totals(spark, sf):
    """Counts by two ranks of a tree, and where each begins when they are laid side by side."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    tree = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("c_nationkey"), "r_name", "n_name")
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(tree, "c_nationkey")
    edge = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("r_name", F.desc("n"), "n_name").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return c.select("r_name", "n_name", "n", edge.alias("left_edge"))


@query(f"WITH {COUNTS}, s AS (SELECT sample, sum(n) AS total FROM c GROUP BY 1) SELECT c.sample, c.entity, c.n FROM c JOIN s USING (sample) WHERE total >= 15000")
def depth_gated(spark, sf):
    return sampling.depth_gate(profile(spark, sf), 15_000).select("sample", "entity", "n")


@query(f"WITH {COUNTS} SELECT entity, count(DISTINCT sample) AS samples FROM c WHERE sample IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 4000) GROUP BY 1")
def unioned_elements(spark, sf):
    """Elements of several samples put together, with how many hold each."""
    s = table(spark, sf, "supplier").where("s_acctbal < 4000").select(F.col("s_suppkey").alias("sample"))
    return profile(spark, sf).join(s, "sample", "left_semi").groupBy("entity").agg(F.count_distinct("sample").alias("samples"))


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS number FROM customer")
def sequential_labels(spark, sf):
    """Ordinals from 0 in order of the keys, in two steps: batches of one."""
    from loomery.operators.dedup import batches

    return batches(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id", 1).select("id", F.col("batch").alias("number"))


@query(f"WITH {COUNTS} SELECT key, sum(n)::BIGINT AS total, row_number() OVER (ORDER BY sum(n) DESC, key) AS place FROM (SELECT p_brand AS key, n FROM c JOIN part ON p_partkey = entity) GROUP BY 1")
def columns_by_total(spark, sf):
    """Columns in order of their totals."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("key"))
    t = profiles.roll_up(profile(spark, sf), p).groupBy("key").agg(F.sum("n").alias("total"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "key")).cast("bigint"))
