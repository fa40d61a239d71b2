"""De-duplication, relations, graphs, trees and k-mers over documents, benchmark, pages and co-purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import alignment, dedup, graph, kmers, relations, summaries, taxonomy
from loomery.plans.registry import query
from loomery.runtime import table

#: Shortest text in a containment, in characters; see containments().
MIN_CONTAINED = 30


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages, with ids below zero to tell them from documents."""
    return table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), F.col("text").alias("seq"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse graph over orders: an order represents the next one of the same customer if it is on the same day of the month."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.dayofmonth("o_orderdate").alias("d"))
    return o.alias("x").join(o.alias("y"), (F.col("x.o_custkey") == F.col("y.o_custkey")) & (F.col("x.d") == F.col("y.d")) & (F.col("x.o_orderkey") < F.col("y.o_orderkey"))).select(F.col("x.o_orderkey").alias("v0"), F.col("y.o_orderkey").alias("v1")).distinct()


EDGES = "g AS (SELECT DISTINCT x.o_orderkey AS v0, y.o_orderkey AS v1 FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND day(x.o_orderdate) = day(y.o_orderdate) AND x.o_orderkey < y.o_orderkey)"
COMPONENTS = f"{EDGES}, b AS (SELECT v0 AS a, v1 AS b FROM g UNION SELECT v1, v0 FROM g), r(a, b) AS (SELECT a, b FROM b UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a), c AS (SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a)"


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS kept_id FROM documents")
def exact_dedup(spark, sf):
    return dedup.exact_duplicates(sequences(spark, sf)).select("id", "kept_id")


@query("SELECT doc_id AS src, '=' AS rel, kept AS dst FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM documents) WHERE doc_id <> kept")
def duplicate_relations(spark, sf):
    return dedup.duplicate_relations(sequences(spark, sf))


@query("SELECT doc_id AS id, length(text) AS len, row_number() OVER (ORDER BY length(text), text, doc_id) AS place FROM documents WHERE length(text) >= 100")
def size_order(spark, sf):
    from pyspark.sql.window import Window

    s = sequences(spark, sf).where(F.length("seq") >= 100).withColumn("len", F.length("seq").cast("bigint"))
    # place = rows of smaller length (few distinct lengths) + place within the length
    per = s.groupBy("len").agg(F.count("*").alias("c"))
    before = per.withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("len", "b")
    own = F.row_number().over(Window.partitionBy("len").orderBy("seq", "id"))
    return s.withColumn("own", own).join(before, "len").select("id", "len", (F.col("b") + F.col("own")).alias("place"))


@query("SELECT doc_id AS id, length(text) AS len, floor(coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100000)::BIGINT AS block FROM documents")
def split_blocks(spark, sf):
    return dedup.blocks_by_size(sequences(spark, sf), 100_000)


@query("SELECT c_custkey AS id, ((row_number() OVER (ORDER BY c_custkey) - 1) // 64)::BIGINT AS batch FROM customer WHERE c_custkey % 3 > 0")
def fixed_batches(spark, sf):
    return dedup.batches(table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id")), "id", 64)


@query("WITH RECURSIVE s AS (SELECT lang AS part, doc_id AS id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents), r AS (SELECT part, id, k, n AS held, 0::BIGINT AS piece FROM s WHERE k = 1 UNION ALL SELECT s.part, s.id, s.k, CASE WHEN held + n > 20000 THEN n ELSE held + n END, CASE WHEN held + n > 20000 THEN piece + 1 ELSE piece END FROM r JOIN s ON s.part IS NOT DISTINCT FROM r.part AND s.k = r.k + 1) SELECT part, id, piece FROM r")
def cut_by_size(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("part"), F.col("doc_id").alias("id"), F.col("text").alias("seq"))
    return dedup.cut_by_size(d, 20_000)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).unionByName(probes(spark, sf))


CORPUS = f"u AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark), t AS (SELECT min(id) AS id, text FROM u WHERE length(text) >= {MIN_CONTAINED} GROUP BY text), k AS (SELECT a.id AS src, 'C' AS rel, b.id AS dst FROM t a JOIN t b ON length(a.text) < length(b.text) AND contains(b.text, a.text)), e AS (SELECT id AS src, '=' AS rel, kept AS dst FROM (SELECT id, min(id) OVER (PARTITION BY text) AS kept FROM u) WHERE id <> kept)"


@query(f"WITH {CORPUS} SELECT src, rel, dst FROM k")
def containment_pairs(spark, sf):
    """Containments among documents and passages alike; copies stand as their smallest id."""
    return dedup.contained(corpus(spark, sf), MIN_CONTAINED)


@query(f"WITH {CORPUS}, r AS (SELECT * FROM k UNION ALL SELECT dst, rel, src FROM e) SELECT DISTINCT k.src, CASE WHEN r.rel = '=' THEN k.rel ELSE r.rel END AS rel, r.dst FROM k JOIN r ON k.dst = r.src UNION SELECT DISTINCT e.src, k.rel, k.dst FROM e JOIN k ON e.dst = k.src")
def relation_compose(spark, sf):
    """Containments followed by containments or by copies of the text that holds, and copies of the text that is held."""
    k, e = containment_pairs(spark, sf), dedup.duplicate_relations(corpus(spark, sf))
    back = e.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    return relations.compose(k, k.unionByName(back)).unionByName(relations.compose(e, k)).distinct()


@query(f"WITH {CORPUS}, a AS (SELECT * FROM k UNION ALL SELECT k.src, 'R', k.dst FROM k WHERE dst % 2 = 0) SELECT src, min(rel) AS rel, dst FROM a GROUP BY src, dst")
def relation_collapse(spark, sf):
    c = containment_pairs(spark, sf)
    return relations.collapse(c.unionByName(c.where("dst % 2 = 0").withColumn("rel", F.lit("R"))))


@query(f"WITH {CORPUS} SELECT DISTINCT id FROM u WHERE id NOT IN (SELECT src FROM k UNION SELECT src FROM e)")
def unexplained(spark, sf):
    c = corpus(spark, sf)
    return relations.unexplained(c.select("id").distinct(), dedup.duplicate_relations(c), containment_pairs(spark, sf))


@query(f"WITH {CORPUS} SELECT DISTINCT src, rel, dst FROM k WHERE dst % 3 = 0 OR src % 3 = 0")
def filter_relations(spark, sf):
    return relations.filter_ends(containment_pairs(spark, sf), corpus(spark, sf).select("id").where("id % 3 = 0"), either=True)


@query(f"WITH RECURSIVE {COMPONENTS} SELECT node, component FROM c")
def connected_components(spark, sf):
    return graph.connected_components(edges(spark, sf), "v0", "v1")


@query(f"WITH RECURSIVE {COMPONENTS} SELECT component, v0, v1 FROM g JOIN c ON node = v0")
def component_edges(spark, sf):
    e = edges(spark, sf)
    return relations.with_component(e, graph.connected_components(e, "v0", "v1"), "v0", "v1").select("component", "v0", "v1")


@query(f"WITH {EDGES} SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT v0 FROM g UNION SELECT v1 FROM g)")
def component_singletons(spark, sf):
    return graph.singletons(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), graph.connected_components(edges(spark, sf), "v0", "v1"))


@query()
def dominating_set(spark, sf):
    return graph.dominating_set(component_edges(spark, sf))


@query()
def catalogue(spark, sf):
    return component_singletons(spark, sf).union(dominating_set(spark, sf).select(F.col("node").alias("id")))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT component, count(*) AS nodes FROM c GROUP BY 1")
def component_sizes(spark, sf):
    return connected_components(spark, sf).groupBy("component").agg(F.count("*").alias("nodes"))


URL = r"^https?://([^?#]*)"


def page_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A tree out of URLs: hosts below the root, then path segments; ranks by depth."""
    p = table(spark, sf, "pages").select(F.split(F.regexp_extract("url", URL, 1), "/").alias("s"))
    n = p.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda k: F.array_join(F.slice("s", 1, k), "/"))).alias("d", "id"))
    n = n.distinct().withColumn("parent", F.when(F.col("d") == 0, "1").otherwise(F.regexp_replace("id", "/[^/]*$", "")))
    named = n.select("id", "parent", F.when(F.col("d") == 0, "host").when(F.col("d") == 1, "section").otherwise("leaf").alias("rank"))
    return named.union(spark.createDataFrame([("1", "1", "root")], named.schema))


TREE = r"p AS (SELECT page_id, string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS s FROM pages), n AS (SELECT DISTINCT array_to_string(s[1:k], '/') AS id, CASE WHEN k = 1 THEN '1' ELSE array_to_string(s[1:k - 1], '/') END AS parent, k, CASE k WHEN 1 THEN 'host' WHEN 2 THEN 'section' ELSE 'leaf' END AS rank FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM p)), w AS (SELECT id, list_prepend('1', list_transform(range(1, k + 1), lambda i: array_to_string(string_split(id, '/')[1:i], '/'))) AS path FROM n UNION ALL SELECT '1', ['1'])"


@query(f"WITH {TREE} SELECT id, array_to_string(path, ' ') AS path FROM w")
def lca_paths(spark, sf):
    return taxonomy.root_paths(page_nodes(spark, sf)).select("id", F.array_join("path", " ").alias("path"))


@query(f"WITH {TREE}, q AS (SELECT page_id % 20 AS grp, path FROM p JOIN w ON w.id = array_to_string(s, '/')), m AS (SELECT grp, min(path) AS lo, max(path) AS hi FROM q GROUP BY 1) SELECT grp, coalesce(list_filter(lo, lambda x, i: lo[1:i] = hi[1:i])[-1], '1') AS lca FROM m")
def lowest_common_ancestor(spark, sf):
    g = table(spark, sf, "pages").select((F.col("page_id") % 20).alias("grp"), F.regexp_extract("url", URL, 1).alias("id"))
    return taxonomy.lca(g, taxonomy.root_paths(page_nodes(spark, sf)), "grp").select("grp", "lca")


@query(f"WITH {TREE} SELECT w.id, max(CASE WHEN len(path) >= 3 THEN path[3] END) AS ancestor FROM w GROUP BY 1")
def ancestor_at_rank(spark, sf):
    n = page_nodes(spark, sf)
    return taxonomy.at_rank(taxonomy.root_paths(n), n, "section")


@query(f"WITH {TREE}, h AS (SELECT min(id) AS h FROM n WHERE rank = 'host') SELECT id FROM w, h WHERE list_contains(path, h)")
def descendant_test(spark, sf):
    n = page_nodes(spark, sf)
    top = n.where("rank = 'host'").agg(F.min("id")).first()[0]
    return taxonomy.descendants(taxonomy.root_paths(n), top)


HITS = "h AS (SELECT l_orderkey AS query, l_partkey AS target, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_discount AS evalue FROM lineitem)"


def hits(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), F.row_number().over(w).alias("at"), F.col("l_discount").alias("evalue"))


@query(f"WITH {HITS}, m AS (SELECT h.*, p_brand AS kingdom FROM h JOIN part ON p_partkey = target WHERE p_partkey % 7 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos, target) AS n FROM m) SELECT query, target, kingdom FROM r WHERE n = 1")
def first_mappable_hit(spark, sf):
    p = table(spark, sf, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("kingdom"))
    return taxonomy.first_hit(hits(spark, sf).join(p, "target", "left"), "query", ["at", "target"], "kingdom").select("query", "target", "kingdom")


@query(f"WITH {TREE}, {HITS}, f AS (SELECT query, evalue AS lim FROM h WHERE pos = 1), k AS (SELECT h.query, 'x' AS one, target % (SELECT count(*) FROM pages) AS page_id FROM h JOIN f USING (query) WHERE evalue <= lim), q AS (SELECT query, path FROM k JOIN p USING (page_id) JOIN w ON w.id = array_to_string(s, '/')), m AS (SELECT query, min(path) AS lo, max(path) AS hi FROM q GROUP BY 1) SELECT query, list_filter(lo, lambda x, i: lo[1:i] = hi[1:i])[-1] AS lca FROM m")
def neighbourhood_lca(spark, sf):
    """Hits on all pages: targets by their remainder by the number of pages."""
    n_pages = F.lit(max(1, table(spark, sf, "pages").count()))
    h = hits(spark, sf)
    limits = h.where("at = 1").select("query", F.col("evalue").alias("limit"))
    near = taxonomy.neighbourhood(h, limits, "query").select("query", (F.col("target") % n_pages).alias("page_id"))
    ids = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", URL, 1).alias("id"))
    return taxonomy.lca(near.join(ids, "page_id").select("query", "id"), taxonomy.root_paths(page_nodes(spark, sf)), "query").select("query", "lca")


@query(f"WITH {TREE}, t AS (SELECT id, parent, rank FROM n UNION ALL SELECT '1', '1', 'root'), c AS (SELECT p_partkey AS entity, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS species, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS kingdom, array_to_string(s, '/') AS predicted FROM part LEFT JOIN p ON page_id = p_partkey) SELECT entity, coalesce(species, kingdom, CASE WHEN rank = 'leaf' THEN parent ELSE predicted END, '1') AS label FROM c LEFT JOIN t ON t.id = predicted")
def reconcile_labels(spark, sf):
    n = page_nodes(spark, sf).withColumn("rank", F.when(F.col("rank") == "leaf", "species").otherwise(F.col("rank")))
    ids = table(spark, sf, "pages").select(F.col("page_id").alias("p_partkey"), F.regexp_extract("url", URL, 1).alias("predicted"))
    c = table(spark, sf, "part").join(ids, "p_partkey", "left").select(F.col("p_partkey").alias("entity"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).alias("species"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("kingdom_label"), "predicted")
    return taxonomy.reconcile(c, n)


INTERVALS = "i AS (SELECT l_orderkey AS query, l_partkey % 100 AS s, l_partkey % 100 + l_quantity AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS hit FROM lineitem)"


@query(f"WITH {INTERVALS} SELECT DISTINCT a.query FROM i a JOIN i b ON a.query = b.query AND a.hit <> b.hit AND least(a.e, b.e) - greatest(a.s, b.s) < 10")
def chimera_candidates(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_partkey") % 100).cast("double").alias("s"), (F.col("l_partkey") % 100 + F.col("l_quantity")).alias("e"))
    return taxonomy.chimera_candidates(i, "query", "s", "e")


SHINGLES = "d AS (SELECT doc_id AS id, string_split(text, ' ') AS w FROM documents), b AS (SELECT -1 - item_id AS id, string_split(text, ' ') AS w FROM benchmark), x AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS kmer FROM d WHERE len(w) >= 5), y AS (SELECT id AS query, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS kmer FROM b WHERE len(w) >= 5)"


@query(f"WITH {SHINGLES} SELECT query, id, count(*) AS shared FROM y JOIN x USING (kmer) GROUP BY ALL HAVING count(*) >= 3")
def kmer_candidates(spark, sf):
    return kmers.candidates(kmers.word_shingles(probes(spark, sf), 5), kmers.word_shingles(sequences(spark, sf), 5), 3)


@query()
def alignment_rank(spark, sf):
    return kmers.ranked(kmer_candidates(spark, sf), probes(spark, sf), sequences(spark, sf))


def candidate_texts(spark: SparkSession, sf: str) -> DataFrame:
    q, d = probes(spark, sf), sequences(spark, sf)
    return kmer_candidates(spark, sf).join(q.select(F.col("id").alias("query"), F.col("seq").alias("a")), "query").join(d.select("id", F.col("seq").alias("b")), "id")


@query()
def pair_relations(spark, sf):
    """Classes of candidate pairs as relations."""
    pairs = candidate_texts(spark, sf).select(F.col("query").alias("a"), alignment.classified("a", "b").alias("code"), F.col("id").alias("b"))
    return relations.normalised(pairs.where("code <> 'X'"))


@query()
def alignment_identity(spark, sf):
    """Identity and coordinates of candidate pairs, and whether their ends overlap."""
    x = candidate_texts(spark, sf).select("query", "id", alignment.aligned("a", "b").alias("x"), F.length("a").alias("a_len"), F.length("b").alias("b_len"))
    return x.select("query", "id", "x.*", "a_len", "b_len").withColumn("joins_ends", summaries.ends_overlap())


@query("SELECT translate(upper(p_brand || p_type), 'YLVE', 'FMIQ') AS code, count(*) AS n FROM part GROUP BY 1")
def reduced_alphabet(spark, sf):
    p = table(spark, sf, "part").select(kmers.reduced(F.concat("p_brand", "p_type")).alias("code"))
    return p.groupBy("code").agg(F.count("*").alias("n"))
