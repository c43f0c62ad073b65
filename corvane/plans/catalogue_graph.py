"""Queries over graphs and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.tokenize import alphanum  # noqa: F401
from corvane.operators import topics
from corvane.operators.graph import Graph, canonical, knn_edges, related_edges
from corvane.plans import cypher
from corvane.plans.registered import query, r6, table, tokens_sql
from corvane.sources.scratch import stage

_EDGES = """s AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS score
                  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    k AS (SELECT x, y, score FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(score, 9) DESC, y) <= 15),
    e AS (SELECT least(x, y) AS src, greatest(x, y) AS dst, max(score) AS weight FROM k WHERE score > 0.1::double GROUP BY ALL),
    b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
    n AS (SELECT vec_id AS indexid FROM embeddings)"""


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("indexid"), F.col("embedding").alias("vector"), "label")
    return Graph(rows.select("indexid", F.col("indexid").cast("string").alias("id"), "label"), stage(knn_edges(rows.select("indexid", "vector")), "edges"))


@query(f"WITH {_EDGES} SELECT src, dst, round(weight, 6) AS weight FROM e")
def graph_knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edges.select("src", "dst", r6("weight").alias("weight"))


@query(f"WITH {_EDGES} SELECT indexid, count(src) AS degree, round(count(src)::double / ((SELECT count(*) FROM n) - 1), 6) AS centrality FROM n LEFT JOIN b ON src = indexid GROUP BY indexid")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).degree().select("indexid", "degree", r6("centrality").alias("centrality"))


def _rank_sql(rounds: int) -> str:
    out = [f"WITH {_EDGES}, c AS (SELECT count(*)::double AS c FROM n), l AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM b)", "r0 AS MATERIALIZED (SELECT indexid, 1 / c AS rank FROM n, c)"]
    for i in range(rounds):
        out.append(f"""r{i + 1} AS MATERIALIZED (SELECT n.indexid, 0.15::double / any_value(c) + 0.85::double * (coalesce(sum(r.rank * l.share), 0) + coalesce((SELECT sum(rank) FROM r{i} WHERE indexid NOT IN (SELECT src FROM l)), 0) / any_value(c)) AS rank
            FROM n CROSS JOIN c LEFT JOIN l ON l.dst = n.indexid LEFT JOIN r{i} r ON r.indexid = l.src GROUP BY n.indexid)""")
    return ", ".join(out) + f" SELECT indexid, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(10))
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).pagerank(10).select("indexid", r6("rank").alias("rank"))


@query()
def graph_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label propagation to its end, which SQL of a fixed number of rounds can't say; tests/test_graph.py holds it against brute force."""
    return graph(spark, sf_dir).labels()


def _distance_sql(rounds: int) -> str:
    out = [f"WITH {_EDGES}, g AS MATERIALIZED (SELECT src, dst, CASE WHEN greatest(1 - weight, 0) >= 0.15 THEN greatest(1 - weight, 0) ELSE 1 END AS length FROM b)", "d0 AS MATERIALIZED (SELECT 0::bigint AS indexid, 0.0::double AS distance)"]
    for i in range(rounds):
        out.append(f"d{i + 1} AS MATERIALIZED (SELECT indexid, min(distance) AS distance FROM (SELECT * FROM d{i} UNION ALL SELECT dst, distance + length FROM d{i} JOIN g ON src = indexid) GROUP BY indexid)")
    return ", ".join(out) + f" SELECT indexid, round(distance, 6) AS distance FROM d{rounds}"


@query(_distance_sql(14))
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).shortest(0).select("indexid", r6("distance").alias("distance"))


@query(f"""WITH {_EDGES},
    p1 AS (SELECT [src, dst] AS p, dst AS t, [least(src, dst) || '-' || greatest(src, dst)] AS u FROM b WHERE src = 0),
    p2 AS (SELECT list_append(p, dst) AS p, dst AS t, list_append(u, least(src, dst) || '-' || greatest(src, dst)) AS u FROM p1 JOIN b ON src = t WHERE NOT list_contains(u, least(src, dst) || '-' || greatest(src, dst))),
    p3 AS (SELECT list_append(p, dst) AS p, dst AS t, u FROM p2 JOIN b ON src = t WHERE NOT list_contains(u, least(src, dst) || '-' || greatest(src, dst)))
    SELECT array_to_string(p, '>') AS path FROM (SELECT p, t FROM p1 UNION ALL SELECT p, t FROM p2 UNION ALL SELECT p, t FROM p3) JOIN embeddings ON vec_id = t WHERE label = 5""")
def graph_paths_1_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of one to three edges from node 0 to nodes of a label."""
    return graph(spark, sf_dir).paths(F.col("indexid") == 0, F.col("label") == 5, 1, 3).select(F.array_join("path", ">").alias("path"))


@query(f"""WITH {_EDGES}, h AS (SELECT b.src, b.dst FROM b)
    SELECT a.vec_id::varchar AS "A", b2.vec_id::varchar AS "B" FROM h JOIN embeddings a ON a.vec_id = src JOIN embeddings b2 ON b2.vec_id = dst
    WHERE a.label = 1 AND b2.label = 2""")
def graph_path_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher.run(graph(spark, sf_dir), "MATCH (A)-[]->(B) WHERE A.label = 1 AND B.label = 2 RETURN A, B", lambda text, n: None, 2_000_000_000)


@query(f"""WITH {_EDGES}, k2 AS (SELECT indexid FROM n JOIN embeddings ON vec_id = indexid WHERE label < 5)
    SELECT src, dst, round(weight, 6) AS weight FROM e WHERE src IN (FROM k2) AND dst IN (FROM k2)""")
def graph_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.induced(g.nodes.where("label < 5").select("indexid")).edges.select("src", "dst", r6("weight").alias("weight"))


@query(f"""WITH {_EDGES} SELECT src, dst, round(weight, 6) AS weight FROM e WHERE src NOT IN (SELECT vec_id FROM embeddings WHERE label = 3) AND dst NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)""")
def graph_delete_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.without(g.nodes.where("label = 3").select("indexid")).edges.select("src", "dst", r6("weight").alias("weight"))


@query(f"WITH {_EDGES} SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM b")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).adjacency().select("src", "dst", F.col("rank").cast("long").alias("rank"))


_COMPONENTS = ", ".join([f"WITH {_EDGES}", "l0 AS MATERIALIZED (SELECT indexid, indexid AS label FROM n)"] + [f"""l{i + 1} AS MATERIALIZED (SELECT l.indexid, least(any_value(l.label), coalesce(min(m.label), any_value(l.label))) AS label
    FROM l{i} l LEFT JOIN b ON src = l.indexid LEFT JOIN l{i} m ON m.indexid = dst GROUP BY l.indexid)""" for i in range(14)]) + " SELECT indexid, label FROM l14"


@query(_COMPONENTS)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).components()


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy modularity; tests hold its invariants."""
    return graph(spark, sf_dir).louvain()


@query("""SELECT least(n_nationkey, 100 + r_regionkey)::bigint AS src, greatest(n_nationkey, 100 + r_regionkey)::bigint AS dst, 1.0::double AS weight
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def graph_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations name their region as a related id."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), (F.col("r_regionkey") + 100).cast("long").alias("indexid"))
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("indexid"), F.array(F.struct(F.concat(F.lit("r"), "n_regionkey").alias("id"))).alias("relationships"))
    return related_edges(docs, regions)


@query(f"""WITH {_EDGES}, o AS (SELECT src, label, count(*) AS c FROM b JOIN embeddings ON vec_id = dst WHERE src % 2 = 1 AND dst % 2 = 0 GROUP BY ALL)
    SELECT src AS indexid, 't' || label AS topic FROM o QUALIFY row_number() OVER (PARTITION BY src ORDER BY c DESC, 't' || label) = 1""")
def graph_infer_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd nodes take the commonest topic around them."""
    g = graph(spark, sf_dir)
    topic = F.when(F.col("indexid") % 2 == 0, F.concat(F.lit("t"), "label"))
    nodes = g.nodes.withColumn("topic", topic).withColumn("category", F.lit(None).cast("string"))
    return Graph(nodes, g.edges).infer(nodes.where("topic is null").select("indexid")).select("indexid", "topic")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("indexid"), "text")


_TOPICS = f"""tok AS (SELECT source AS grp, doc_id AS indexid, {tokens_sql("text")} AS w FROM documents WHERE text IS NOT NULL),
    post AS (SELECT grp, indexid, dl, term, count(*) AS tf FROM (SELECT grp, indexid, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
    df AS (SELECT grp, term, count(*) AS df FROM post GROUP BY ALL),
    t AS (SELECT grp, term, df, row_number() OVER (PARTITION BY grp ORDER BY df DESC, term) AS rank FROM df QUALIFY rank <= 4)"""


@query(f"WITH {_TOPICS} SELECT grp, rank, term, df FROM t")
def topics_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_terms(groups(spark, sf_dir))


@query(f"""WITH {_TOPICS}, g AS (SELECT grp, count(*) AS n, avg(len(w)) AS avgdl FROM tok GROUP BY grp),
    l AS (SELECT grp, string_agg(term, '_' ORDER BY rank) AS topic FROM t GROUP BY grp),
    s AS (SELECT grp, indexid, sum(ln(1 + (n - t.df + 0.5::double) / (t.df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) AS score
          FROM post JOIN t USING (grp, term) JOIN g USING (grp) GROUP BY grp, indexid)
    SELECT topic, indexid, round(score, 6) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, indexid) - 1 AS topicrank FROM s JOIN l USING (grp)""")
def topic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.ranked(groups(spark, sf_dir)).select("topic", "indexid", r6("score").alias("score"), "topicrank")


@query("""WITH t AS (SELECT label, avg_v FROM (SELECT label, list(v ORDER BY i) AS avg_v FROM (SELECT label, i, avg(embedding[i]::double) AS v FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL) GROUP BY label)),
    c AS (SELECT 'c' || vec_id AS category, embedding::double[] AS v FROM embeddings WHERE vec_id < 5)
    SELECT 't' || label AS topic, category FROM t, c QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(list_cosine_similarity(avg_v, v), 9) DESC, category) = 1""")
def topic_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of labels as topics, a few vectors as categories."""
    rows = table(spark, sf_dir, "embeddings")
    cells = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    names = rows.where("vec_id < 5").select(F.concat(F.lit("c"), "vec_id").alias("category"), F.col("embedding").alias("vector"))
    return topics.categories(means.select(F.concat(F.lit("t"), "label").alias("topic"), "vector"), names)
