"""The engine's operators applied to the driver's tables, each with its SQL statement: texts, graph, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions import intent, parsing, text, vector
from quarrygraph.operators import components, dense, extraction, graph, intents, lexical, pairs, resolution, retrieval
from quarrygraph.operators.ranking import top_k
from quarrygraph.plans.register import query
from quarrygraph.sources import corpora
from quarrygraph.sources.tables import cut, table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Line items as relation triples: an order is a chunk, part and supplier are its nodes, the return flag the context; some have no relation text."""
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("context_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("node_1"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("node_2"),
        F.when(F.col("l_partkey") % 5 > 0, F.col("l_linestatus")).alias("edge"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").cast("long").alias("line"),
    )


EDGES = "e AS (SELECT l_returnflag context_id, 'P' || l_partkey node_1, 'S' || l_suppkey node_2, CASE WHEN l_partkey % 5 > 0 THEN l_linestatus END edge, l_orderkey chunk_id, CAST(l_linenumber AS BIGINT) line FROM lineitem)"


@query("SELECT doc_id AS chunk_id, source || ' information: ' || text AS content FROM documents")
def chunk_project(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), text.prefixed(F.col("source"), F.col("text")).alias("content"))


@query("SELECT source AS context_id, lang AS title, min(doc_id) AS pos FROM documents GROUP BY source, lang")
def title_dedup(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("context_id"), F.col("lang").alias("title"), F.col("doc_id").alias("pos"))
    return corpora.first_titles(rows)


@query(
    "WITH p AS (SELECT source, lang, doc_id, string_split(text, chr(10)) parts FROM documents), e AS (SELECT source, lang, doc_id, unnest(parts) piece, generate_subscripts(parts, 1) part FROM p) "
    "SELECT source AS context_id, row_number() OVER (ORDER BY source, doc_id, part) - 1 AS chunk_id, lang AS title, lang || ' information: ' || piece AS text FROM e"
)
def seq_chunk_id(spark, d):
    """Paragraphs cut at line ends, numbered without gaps over (context, paragraph, part)."""
    rows = table(spark, d, "documents").select(F.col("source").alias("context_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("title"), "text")
    return corpora.number_chunks(rows, lambda t: F.split(t, "\n"))


@query("SELECT doc_id, coalesce(l.text, d.text) AS resolved_text FROM documents d LEFT JOIN (SELECT item_id, text FROM benchmark) l ON d.doc_id = l.item_id")
def coalesce_resolved(spark, d):
    """Chunks with their resolved text where a resolver gave one (here for the ids of the benchmark)."""
    resolved = table(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("resolved_text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return extraction.resolved_text(docs, resolved).select(F.col("chunk_id").alias("doc_id"), "resolved_text")


@query("SELECT doc_id, n_chars, 'src3' AS asked FROM documents WHERE source = 'src3' UNION ALL SELECT doc_id, n_chars, 'Global' FROM documents")
def context_mask(spark, d):
    """The rows of one context, and those of the global one."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.col("source").alias("context_id"))
    both = [retrieval.in_context(docs, c).select("doc_id", "n_chars", F.lit(c).alias("asked")) for c in ("src3", "Global")]
    return both[0].unionByName(both[1])


@query("SELECT d.doc_id, e.label, coalesce(len(e.embedding), 0) AS dim FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def left_embed_join(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").cast("long").alias("dim"))
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left").select("doc_id", "label", F.coalesce("dim", F.lit(0)).cast("long").alias("dim"))


@query("SELECT doc_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_allowed(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_visited(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


MENTIONS = (
    "m AS (SELECT vec_id ord, 'c' || (vec_id % 3) context_id, vec_id // 7 chunk_id, CASE label % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Concept' ELSE 'Other' END category, "
    "p_name || CASE vec_id % 7 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' SR' ELSE '' END entity, [p_brand, CASE WHEN vec_id % 2 = 0 THEN p_type ELSE p_brand END] synonyms, "
    "CASE WHEN vec_id % 5 = 0 THEN '-1' ELSE p_type END description, embedding FROM embeddings JOIN part ON p_partkey = vec_id % 180 + 1)"
)
RADII = {"Person": 0.70, "Concept": 0.72}


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as mentions of entities: the parts' names, some with a generation, in three contexts and categories."""
    e, p = table(spark, d, "embeddings"), table(spark, d, "part")
    i = F.col("vec_id")
    return e.join(p, p.p_partkey == i % 180 + 1).select(
        i.alias("ord"), F.concat(F.lit("c"), (i % 3).cast("string")).alias("context_id"), F.floor(i / 7).alias("chunk_id"),
        F.when(F.col("label") % 3 == 0, "Person").when(F.col("label") % 3 == 1, "Concept").otherwise("Other").alias("category"),
        F.concat("p_name", F.when(i % 7 == 0, " Jr.").when(i % 7 == 1, " SR").otherwise("")).alias("entity"),
        F.array("p_brand", F.when(i % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand"))).alias("synonyms"),
        F.when(i % 5 == 0, "-1").otherwise(F.col("p_type")).alias("description"), F.col("embedding").alias("vector"),
    )


@query(
    f"WITH {MENTIONS}, x AS (SELECT context_id, entity, category, ord, unnest(list_append(synonyms, entity)) s FROM m) "
    "SELECT *, 'Entity: ' || entity || '. synonyms: ' || synonyms AS rich_text FROM (SELECT context_id, entity, category, min(ord) AS ord, array_to_string(list_sort(list_distinct(list(s))), ' | ') AS synonyms FROM x GROUP BY ALL)"
)
def rich_synonyms(spark, d):
    return resolution.rich_entities(_mentions(spark, d))


# Clusters, standard names and the persons' pass, then the mapping onto all mentions.
GENERATION = "CASE WHEN category <> 'Person' THEN NULL WHEN entity LIKE '% Jr.' THEN 2 WHEN entity LIKE '% SR' THEN 1 END"
CLEAN = r"lower(regexp_replace(regexp_replace(trim({0}), '(?i)\s+(Jr|Sr|Dr|Prof|King|Sultan|President|Queen|Princess)\b\.?', '', 'g'), '[^A-Za-z0-9]', '', 'g'))"
STANDARD = (
    f"{MENTIONS}, u AS (SELECT context_id, category, entity, min(ord) ord, arg_min(embedding, ord) e, {GENERATION} g, CASE category WHEN 'Person' THEN 0.70 WHEN 'Concept' THEN 0.72 ELSE 0.10 END radius FROM m GROUP BY context_id, category, entity), "
    "p AS (SELECT a.ord x, b.ord y FROM u a JOIN u b USING (context_id, category) WHERE a.ord <> b.ord AND NOT coalesce(a.g <> b.g, false) AND round(1 - list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])), 6) < a.radius), "
    "r(x, y) AS (SELECT ord, ord FROM u UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x), c AS (SELECT x ord, min(y) component FROM r GROUP BY x), "
    "k AS (SELECT *, dense_rank() OVER (PARTITION BY context_id ORDER BY category, component) - 1 cluster_id FROM u JOIN c USING (ord)), "
    "n AS (SELECT context_id, category, component, arg_min(entity, struct_pack(a := -length(entity), b := ord)) standard FROM k GROUP BY ALL), "
    f"q AS (SELECT k.*, n.standard, {CLEAN.format('entity')} cl FROM k JOIN n USING (context_id, category, component)), "
    "t AS (SELECT a.context_id, a.ord i, b.ord j, CASE WHEN length(a.entity) > length(b.entity) THEN a.entity ELSE b.entity END nw FROM q a JOIN q b ON a.context_id = b.context_id AND a.ord < b.ord AND a.category = 'Person' AND b.category = 'Person' "
    "AND a.cl <> '' AND b.cl <> '' AND a.cl <> b.cl AND a.standard <> b.standard AND (contains(a.cl, b.cl) OR contains(b.cl, a.cl))), "
    "l AS (SELECT ord, arg_max(nw, struct_pack(a := i, b := j)) nw FROM (SELECT i ord, i, j, nw FROM t UNION ALL SELECT j, i, j, nw FROM t) GROUP BY ord), "
    "s AS (SELECT q.context_id, q.category, q.entity, coalesce(l.nw, q.standard) standard_entity, q.cluster_id FROM q LEFT JOIN l USING (ord))"
)


def _standardized(spark: SparkSession, d: str) -> DataFrame:
    return resolution.standardize_entities(_mentions(spark, d), radii=RADII)


@query(f"WITH RECURSIVE {STANDARD} SELECT m.ord, m.context_id, m.category, m.entity, s.standard_entity, CAST(s.cluster_id AS BIGINT) AS cluster_id FROM m JOIN s USING (context_id, category, entity)")
def standardize_entities(spark, d):
    return _standardized(spark, d).select("ord", "context_id", "category", "entity", "standard_entity", "cluster_id")


@query(
    f"WITH RECURSIVE {STANDARD}, v AS (SELECT m.*, s.standard_entity, s.cluster_id FROM m JOIN s USING (context_id, category, entity)), "
    "y AS (SELECT context_id, standard_entity, category, array_to_string(list_sort(list_distinct(list(s))), '|') synonyms FROM (SELECT *, unnest(list_append(synonyms, entity)) s FROM v) GROUP BY ALL) "
    "SELECT v.context_id, v.standard_entity, v.category, arg_min(chunk_id, ord) AS chunk_id, CAST(arg_min(cluster_id, ord) AS BIGINT) AS cluster_id, "
    "coalesce(array_to_string(list_sort(list_distinct(list(description) FILTER (description <> '-1'))), '. '), '') AS description, any_value(y.synonyms) AS synonyms "
    "FROM v JOIN y USING (context_id, standard_entity, category) GROUP BY ALL"
)
def merge_concepts(spark, d):
    return resolution.merge_concepts(_standardized(spark, d)).withColumn("synonyms", F.array_join("synonyms", "|"))


@query(
    f"WITH RECURSIVE {STANDARD}, v AS (SELECT m.context_id, m.chunk_id, m.entity, arg_max(s.standard_entity, m.ord) st FROM m JOIN s USING (context_id, category, entity) GROUP BY ALL) "
    "SELECT context_id, chunk_id, string_agg(entity || '>' || st, '|' ORDER BY entity) AS names FROM v GROUP BY ALL"
)
def entity_map(spark, d):
    """What a chunk's mentions stand for, written out in order."""
    found = resolution.entity_map(_standardized(spark, d))
    pairs = F.transform(F.array_sort(F.map_entries("names")), lambda e: F.concat(e["key"], F.lit(">"), e["value"]))
    return found.select("context_id", "chunk_id", F.array_join(pairs, "|").alias("names"))


@query(
    "WITH x AS (SELECT l_orderkey o, max(l_suppkey) standard_entity, max(l_partkey) cluster_id FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1) GROUP BY 1) "
    "SELECT o_orderkey AS ord, o_orderstatus AS context_id, o_orderpriority AS category, CAST(o_orderkey // 2 * 2 AS VARCHAR) AS entity, "
    "coalesce(CAST(x.standard_entity AS VARCHAR), CAST(o_orderkey // 2 * 2 AS VARCHAR)) AS standard_entity, coalesce(x.cluster_id, -1) AS cluster_id FROM orders LEFT JOIN x ON x.o = o_orderkey // 2 * 2 AND o_orderstatus <> 'P'"
)
def mapping_left_default(spark, d):
    """Mentions onto a mapping with repeated keys (the last counts) and without some (the name itself and -1).

    The statement leaves open which of an order's rows of equal line and part is the last; here it is the
    one of the smallest supplier, in whatever order rows come.
    """
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    key = (F.floor(F.col("o_orderkey") / 2) * 2).cast("string")
    mentions = o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("context_id"), F.col("o_orderpriority").alias("category"), key.alias("entity"))
    every = mentions.select("context_id", "category", "entity").distinct().where("context_id <> 'P'")
    last = F.struct("l_linenumber", "l_partkey", -F.col("l_suppkey"))
    mapping = li.select(F.col("l_orderkey").cast("string").alias("entity"), last.alias("ord"), F.col("l_suppkey").cast("string").alias("standard_entity"), F.col("l_partkey").alias("cluster_id")).join(every, "entity")
    return resolution.apply_mapping(mentions, mapping)


@query(
    "WITH e AS (SELECT event_id, user_id, nullif(event_type, 'view') a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END b, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END c FROM events) "
    "SELECT CAST(user_id AS VARCHAR) AS context_id, a AS node_1, b AS node_2, CAST(NULL AS VARCHAR) AS edge, TRY_CAST(c AS BIGINT) AS chunk_id FROM e WHERE a IS NOT NULL AND b IS NOT NULL"
)
def conform_edges(spark, d):
    """Loose edges brought to the fixed columns: blanks to null, a missing column, chunk ids that are no numbers."""
    i = F.col("event_id")
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("context_id"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("node_1"),
        F.when(i % 4 != 0, F.col("event_type")).alias("node_2"), F.when(i % 3 == 0, F.concat(F.lit("x"), i)).otherwise(i.cast("string")).alias("chunk_id"),
    )
    return graph.conform_edges(rows)


COOCCURRENCE = (
    EDGES + ", n AS (SELECT context_id, chunk_id, node_1 node FROM e UNION ALL SELECT context_id, chunk_id, node_2 FROM e), "
    "c AS (SELECT a.context_id, a.node node_1, b.node node_2, array_to_string(list_sort(list_distinct(list(CAST(a.chunk_id AS VARCHAR)))), ',') chunk_id, CAST(count(*) AS BIGINT) \"count\" "
    "FROM n a JOIN n b ON a.chunk_id = b.chunk_id WHERE a.node <> b.node GROUP BY ALL HAVING count(*) > 2)"
)


@query(f"WITH {COOCCURRENCE} SELECT * FROM c")
def cooccurrence(spark, d):
    return graph.cooccurrence(_edges(spark, d))


SCORED = COOCCURRENCE + ', s AS (SELECT *, ln(1 + "count") / ln(1 + (SELECT max("count") FROM c) + 1e-5) implicit_score FROM c)'


@query(f'WITH {SCORED} SELECT context_id, node_1, node_2, round(implicit_score, 6) AS implicit_score FROM s')
def implicit_score(spark, d):
    return graph.implicit_score(graph.cooccurrence(_edges(spark, d))).select("context_id", "node_1", "node_2", F.round("implicit_score", 6).alias("implicit_score"))


HYBRID = (
    SCORED + ", b AS (SELECT node_1, node_2, context_id, CAST(chunk_id AS VARCHAR) chunk_id, edge, chunk_id * 10 + line ord, CAST(NULL AS DOUBLE) score, true explicit FROM e "
    "UNION ALL SELECT node_1, node_2, context_id, unnest(string_split(chunk_id, ',')), NULL, NULL, implicit_score, false FROM s), "
    "h AS (SELECT least(node_1, node_2) u, greatest(node_1, node_2) v, list_sort(list_distinct(list(chunk_id))) chunk_ids, list_sort(list_distinct(list(context_id))) context_ids, "
    "CASE WHEN bool_or(explicit) THEN min(struct_pack(a := ord, b := edge)) FILTER (explicit).b ELSE 'co-occurs with' END relation, max(score) implicit_score, bool_or(explicit) is_explicit FROM b GROUP BY 1, 2)"
)


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).withColumn("ord", F.col("chunk_id") * 10 + F.col("line"))
    return graph.hybrid_edges(edges, graph.implicit_score(graph.cooccurring(edges)))


@query(f"WITH {HYBRID} SELECT u, v, array_to_string(chunk_ids, ',') AS chunk_ids, array_to_string(context_ids, ',') AS context_ids, relation, round(implicit_score, 6) AS implicit_score, is_explicit FROM h")
def hybrid_edges(spark, d):
    h = _hybrid(spark, d)
    return h.select("u", "v", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.array_join("context_ids", ",").alias("context_ids"), "relation", F.round("implicit_score", 6).alias("implicit_score"), "is_explicit")


W = (0.15, 0.40, 0.45)


@query(
    f"WITH {HYBRID}, a AS (SELECT u, v, context_ids, is_explicit, coalesce(implicit_score, 0) si FROM h UNION ALL SELECT v, u, context_ids, is_explicit, coalesce(implicit_score, 0) FROM h WHERE u <> v), "
    "w AS (SELECT u, v, is_explicit, CASE WHEN is_explicit THEN 0.5 * 0.45 + 0.4 * s WHEN s > 0.6 OR (si > 0.35 AND s > 0.35) THEN 0.3 * 0.45 + 0.15 * si + 0.4 * s ELSE 0 END w "
    "FROM (SELECT *, (CAST(substr(v, 2) AS BIGINT) % 97) / 97.0 s FROM a WHERE u LIKE 'S%' AND list_contains(context_ids, 'R'))), "
    "r AS (SELECT u, v, is_explicit, round(w, 6) weight, row_number() OVER (PARTITION BY u ORDER BY round(w, 6) DESC, v) AS rank FROM w WHERE w >= 0.05) SELECT * FROM r WHERE rank <= 12"
)
def expand_neighbors(spark, d):
    """Neighbours of every supplier inside context R: hybrid weights, floor 0.05, the best 12 a node."""
    edges = _edges(spark, d)
    near = pairs.context_adjacency(edges, graph.implicit_score(graph.cooccurring(edges)), "R").where("u LIKE 'S%'")
    semantic = (F.substring("v", 2, 20).cast("long") % 97) / F.lit(97.0)
    w = vector.edge_weight(F.col("is_explicit"), F.coalesce("implicit_score", F.lit(0.0)), semantic, *W)
    rows = near.select("u", "v", "is_explicit", w.alias("w")).where("w >= 0.05").select("u", "v", "is_explicit", F.round("w", 6).alias("weight"))
    return top_k(rows, 12, ["u"], [F.desc("weight"), F.asc("v")])


@query(
    f"WITH RECURSIVE {EDGES}, a AS (SELECT DISTINCT node_1 u, node_2 v FROM e WHERE context_id = 'R' UNION SELECT DISTINCT node_2, node_1 FROM e WHERE context_id = 'R'), "
    "k(node, hop) AS (SELECT 'S1', 0 UNION SELECT a.v, k.hop + 1 FROM k JOIN a ON a.u = k.node WHERE k.hop < 2) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM k GROUP BY node"
)
def khop(spark, d):
    """Nodes within two hops of one supplier, breadth first with a visited set."""
    e = _edges(spark, d).where("context_id = 'R'")
    adj = e.select(F.col("node_1").alias("u"), F.col("node_2").alias("v")).union(e.select("node_2", "node_1"))
    return graph.reach(adj, spark.range(1).select(F.lit("S1").alias("node")), 2)


@query("SELECT label, vec_id, CAST(dense_rank() OVER (PARTITION BY label ORDER BY vec_id // 50) - 1 AS BIGINT) AS cluster_id FROM embeddings")
def cluster_offset(spark, d):
    w = Window.partitionBy("label").orderBy(F.floor(F.col("vec_id") / 50))
    return table(spark, d, "embeddings").select("label", "vec_id", (F.dense_rank().over(w) - 1).cast("long").alias("cluster_id"))


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    f"WITH RECURSIVE p AS (SELECT a.vec_id x, b.vec_id y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE round(1 - {COS}, 6) < 0.72), "
    "r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x) SELECT x AS vec_id, min(y) AS component FROM r GROUP BY x"
)
def cluster_components(spark, d):
    """Single linkage inside a block, cut at a radius: components of the pairs closer than it."""
    e = table(spark, d, "embeddings")
    links = dense.close_links(e.withColumn("radius", F.lit(0.72)), ["label"], key="vec_id", vector="embedding")
    found = components.connected_components(links)
    return e.join(found, e.vec_id == found.node, "left").select("vec_id", F.coalesce("component", "vec_id").alias("component"))


@query(
    f"SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10"
)
def cosine_topk_global(spark, d):
    """Every vector whose id is divisible by 100 against all vectors."""
    e = table(spark, d, "embeddings")
    found = dense.dense_top_k(e, e.where("vec_id % 100 = 0"), 10, (("embedding", "embedding", 1.0),), item_key="vec_id", query_key="vec_id")
    return found.withColumnRenamed("id", "vec_id")


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
BM25 = (
    f"t AS (SELECT doc_id id, unnest({TOKENS}) t FROM documents), tf AS (SELECT id, t, count(*) tf FROM t GROUP BY ALL), dl AS (SELECT doc_id id, len({TOKENS}) dl FROM documents), "
    "c AS (SELECT count(*) n, avg(dl) avgdl FROM dl), idf AS (SELECT t, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) idf FROM tf, c GROUP BY t, n), "
    f"q AS (SELECT item_id query_id, unnest({TOKENS}) t FROM benchmark), "
    "w AS (SELECT query_id, t, count(*) * CASE WHEN any_value(idf) < 0 THEN (SELECT 0.25 * avg(idf) FROM idf) ELSE any_value(idf) END w FROM q JOIN idf USING (t) GROUP BY query_id, t), "
    "bm AS (SELECT query_id, id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score FROM tf JOIN w USING (t) JOIN dl USING (id), c GROUP BY query_id, id)"
)


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return lexical.bm25(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(f"WITH {BM25} SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm) WHERE rank <= 10")
def bm25(spark, d):
    return top_k(_bm25(spark, d).withColumn("score", F.round("score", 6)), 10, ["query_id"], [F.desc("score"), F.asc("id")])


@query(
    f"WITH d AS (SELECT source, doc_id, {TOKENS} k FROM documents), q AS (SELECT 'src' || (item_id % 16) source, item_id query_id, {TOKENS} k FROM benchmark), t AS (SELECT source, doc_id id, unnest(k) t FROM d), "
    "tf AS (SELECT source, id, t, count(*) tf FROM t GROUP BY ALL), c AS (SELECT source, count(*) n, avg(len(k)) avgdl FROM d GROUP BY source), "
    "idf AS (SELECT source, t, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) idf FROM tf JOIN c USING (source) GROUP BY ALL), f AS (SELECT source, 0.25 * avg(idf) floor FROM idf GROUP BY source), "
    "w AS (SELECT source, query_id, t, count(*) * CASE WHEN any_value(idf) < 0 THEN any_value(floor) ELSE any_value(idf) END w FROM (SELECT source, query_id, unnest(k) t FROM q) JOIN idf USING (source, t) JOIN f USING (source) GROUP BY ALL) "
    "SELECT source, query_id, id, round(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.k) / avgdl))), 6) AS score FROM tf JOIN w USING (source, t) JOIN c USING (source) JOIN d ON d.doc_id = tf.id GROUP BY source, query_id, id"
)
def bm25_by_context(spark, d):
    """Each source is a corpus of its own, each question asks one."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 16).cast("string")).alias("source"), F.col("item_id").alias("query_id"), "text")
    return lexical.bm25(docs, asked, by=["source"]).withColumn("score", F.round("score", 6))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def theta_contains(spark, d):
    """Containment join of whole texts and all questions, by an index of each question's longest inner token."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    return lexical.containment(docs, phrases).select(F.col("phrase_id").alias("item_id"), F.col("id").alias("doc_id"))


def _linkable(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as entities, named by two places of their text and described by the reversed vector; the benchmark as questions."""
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    vectors = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("name_vector"), F.reverse("embedding").alias("desc_vector"))
    names = F.array(F.substring(F.col("text"), 1, 7), F.substring(F.col("text"), 31, 24))
    entities = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("context_id"), names.alias("names"), "text").join(vectors, "id", "left")
    item = F.col("item_id")
    queries = table(spark, d, "benchmark").select(item.alias("query_id"), F.concat(F.lit("src"), (item % 16).cast("string")).alias("context_id"), "text")
    return entities, queries.join(vectors.withColumnRenamed("id", "query_id"), "query_id", "left")


def _fused(local: bool) -> str:
    """The statement of linking over all documents, or over those of a question's source."""
    bm = BM25 if not local else ORACLE_LOCAL
    here = " AND d.source = 'src' || (b.item_id % 16)" if local else ""
    cos = lambda f: f"coalesce(list_cosine_similarity(CAST({f}(e1.embedding) AS DOUBLE[]), CAST({f}(e2.embedding) AS DOUBLE[])), 0)"
    hit = lambda x: f"(length(trim(lower({x}))) >= 2 AND contains(lower(b.text), trim(lower({x}))))"
    return (
        f"WITH {bm}, mx AS (SELECT query_id, max(score) mx FROM bm GROUP BY 1), f AS (SELECT b.item_id query_id, d.doc_id id, round(0.25 * {cos('')} + 0.40 * {cos('list_reverse')} "
        f"+ 0.15 * ({hit('substr(d.text, 1, 7)')} OR {hit('substr(d.text, 31, 24)')})::INT + 0.20 * coalesce(bm.score, 0) / CASE WHEN coalesce(mx, 0) > 0 THEN mx ELSE 1 END, 6) score "
        f"FROM benchmark b JOIN documents d ON true{here} LEFT JOIN embeddings e1 ON e1.vec_id = b.item_id LEFT JOIN embeddings e2 ON e2.vec_id = d.doc_id LEFT JOIN bm ON bm.query_id = b.item_id AND bm.id = d.doc_id LEFT JOIN mx ON mx.query_id = b.item_id) "
        "SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10"
    )


ORACLE_LOCAL = (
    f"d0 AS (SELECT source, doc_id, {TOKENS} k FROM documents), q0 AS (SELECT 'src' || (item_id % 16) source, item_id query_id, {TOKENS} k FROM benchmark), tf AS (SELECT source, id, t, count(*) tf FROM (SELECT source, doc_id id, unnest(k) t FROM d0) GROUP BY ALL), "
    "c AS (SELECT source, count(*) n, avg(len(k)) avgdl FROM d0 GROUP BY source), idf AS (SELECT source, t, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) idf FROM tf JOIN c USING (source) GROUP BY ALL), "
    "fl AS (SELECT source, 0.25 * avg(idf) floor FROM idf GROUP BY source), w AS (SELECT source, query_id, t, count(*) * CASE WHEN any_value(idf) < 0 THEN any_value(floor) ELSE any_value(idf) END w FROM (SELECT source, query_id, unnest(k) t FROM q0) JOIN idf USING (source, t) JOIN fl USING (source) GROUP BY ALL), "
    "bm AS (SELECT query_id, id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d0.k) / avgdl))) score FROM tf JOIN w USING (source, t) JOIN c USING (source) JOIN d0 ON d0.doc_id = tf.id GROUP BY query_id, id)"
)


@query(_fused(False))
def fused_link(spark, d):
    """Entity linking of every question over all documents: two vectors, containment of names, BM25."""
    return retrieval.link_entities(*_linkable(spark, d))


@query(_fused(True))
def fused_link_local(spark, d):
    """The same inside each question's own context."""
    return retrieval.link_entities(*_linkable(spark, d), local=True)


