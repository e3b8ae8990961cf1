"""Answers, questions and replies: normalising, scoring, reports, features and weights, each with its SQL statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import intent, parsing, text, vector
from quarrygraph.operators import evaluate, graph, intents, persons
from quarrygraph.operators.resolution import radius_of
from quarrygraph.plans.register import query
from quarrygraph.sources import corpora
from quarrygraph.sources.tables import table

NORMAL = r"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(trim(replace(replace(replace(lower({0}), ' until ', '-'), ' to ', '-'), ' and ', ', ')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'), ' '), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"


@query(f"SELECT item_id, {NORMAL.format('text')} AS answer FROM benchmark")
def normalize_answer(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.normalize_answer(F.col("text")).alias("answer"))


# Neighbouring turns as answers; some are yes, no or noanswer, some are marked up, some have no gold.
PAIRS = (
    "p0 AS (SELECT a.conv_id, a.turn, CASE (a.conv_id * 3 + a.turn) % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE a.text END gold_answer, "
    "CASE (a.conv_id + a.turn) % 6 WHEN 0 THEN 'yes it is' WHEN 1 THEN '**Final Answer:** ' || a.text || '.' || chr(10) || 'more' WHEN 2 THEN 'Answer: No.' WHEN 3 THEN 'The conclusion: `' || left(b.text, 40) || '`' ELSE b.text END pred_answer, "
    "CASE (a.conv_id * 5 + a.turn) % 8 WHEN 0 THEN '(Retrieval, P=0.91) -> Agent-Zero-Shot' WHEN 1 THEN '(Relational, P=0.71) -> Agent-Hop-1' WHEN 2 THEN '(Comparative, P=0.66) -> Fallback' WHEN 3 THEN 'Vector-RAG' WHEN 4 THEN '(Default, P=0.51) -> Agent-Hop-2' "
    "WHEN 5 THEN 'Fallback' WHEN 6 THEN '(Reasoning, P=0.80) -> Fallback' ELSE 'No-Seeds' END strategy "
    "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), "
    r"p1 AS (SELECT *, replace(replace(coalesce(pred_answer, ''), '**', ''), '__', '') y FROM p0), "
    r"p2 AS (SELECT *, CASE WHEN contains(lower(y), 'final answer:') THEN regexp_replace(y, '(?is)^.*final answer:', '') WHEN contains(lower(y), 'final answer') THEN regexp_replace(y, '(?is)^.*final answer', '') "
    r"WHEN contains(lower(y), 'answer:') THEN regexp_replace(y, '(?is)^.*answer:', '') WHEN contains(lower(y), 'conclusion:') THEN regexp_replace(y, '(?is)^.*conclusion:', '') WHEN contains(lower(y), 'answer') THEN regexp_replace(y, '(?is)^.*answer', '') ELSE y END z FROM p1), "
    r"p AS (SELECT conv_id, turn, gold_answer, pred_answer, strategy, trim(replace(regexp_replace(trim(string_split(trim(regexp_replace(z, '^\s+', '')), chr(10))[1]), '\.$', ''), '`', '')) answer FROM p2)"
)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    i, t, a = F.col("conv_id"), F.col("turn"), F.col("text")
    gold, said, kind = (i * 3 + t) % 7, (i + t) % 6, (i * 5 + t) % 8
    strategies = ("(Retrieval, P=0.91) -> Agent-Zero-Shot", "(Relational, P=0.71) -> Agent-Hop-1", "(Comparative, P=0.66) -> Fallback", "Vector-RAG", "(Default, P=0.51) -> Agent-Hop-2", "Fallback", "(Reasoning, P=0.80) -> Fallback", "No-Seeds")
    pred = F.when(said == 0, "yes it is").when(said == 1, F.concat(F.lit("**Final Answer:** "), a, F.lit(".\nmore"))).when(said == 2, "Answer: No.").when(said == 3, F.concat(F.lit("The conclusion: `"), F.substring("b", 1, 40), F.lit("`"))).otherwise(F.col("b"))
    return c.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.when(gold == 0, "Yes").when(gold == 1, "no").otherwise(a).alias("gold_answer"), pred.alias("pred_answer"), F.get(F.lit(list(strategies)), kind.cast("int")).alias("strategy")
    )


def _scored(p: str, g: str, keys: str) -> str:
    """Statement parts that give ``f`` (f1, precision, recall) of the answers in columns ``p`` and ``g``."""
    return (
        f"k AS (SELECT *, {NORMAL.format(p)} np, {NORMAL.format(g)} ng FROM p), "
        f"u AS (SELECT {keys}, t, sum(x) x, sum(y) y FROM (SELECT {keys}, unnest(string_split(np, ' ')) t, 1 x, 0 y FROM k UNION ALL SELECT {keys}, unnest(string_split(ng, ' ')), 0, 1 FROM k) WHERE t <> '' GROUP BY ALL), "
        f"h AS (SELECT {keys}, sum(least(x, y)) s, sum(x) a, sum(y) b FROM u GROUP BY ALL), "
        f"f AS (SELECT k.*, CASE WHEN coalesce(s, 0) = 0 OR ((np IN ('yes', 'no', 'noanswer') OR ng IN ('yes', 'no', 'noanswer')) AND np <> ng) THEN 0 ELSE s END same, a, b FROM k LEFT JOIN h USING ({keys})), "
        "sc AS (SELECT *, CASE WHEN same = 0 THEN 0.0 ELSE 2.0 * same / (a + b) END f1, CASE WHEN same = 0 THEN 0.0 ELSE same / a END prec, CASE WHEN same = 0 THEN 0.0 ELSE same / b END rec, "
        "(np = ng)::INT em, (CASE WHEN ng IN ('yes', 'no', 'noanswer') THEN np = ng ELSE contains(np, ng) END)::INT contain FROM f)"
    )


@query(f"WITH {PAIRS}, {_scored('pred_answer', 'gold_answer', 'conv_id, turn')} SELECT conv_id, turn, round(f1, 6) AS f1, round(prec, 6) AS prec, round(rec, 6) AS rec FROM sc")
def token_f1(spark, d):
    """Token overlap of raw answers; a yes, no or noanswer counts as a whole."""
    found = evaluate.token_scores(_pairs(spark, d), ["conv_id", "turn"], "pred_answer", "gold_answer")
    return found.select("conv_id", "turn", F.round("f1", 6).alias("f1"), F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("rec"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, answer FROM p")
def extract_answer(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", text.extract_final_answer(F.col("pred_answer")).alias("answer"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).withColumns({"intent": intents.intent_of(F.col("strategy")), "strategy": intents.strategy(F.col("strategy"))})
    return evaluate.score_answers(rows, ["conv_id", "turn"])


JUDGED = (
    f"{PAIRS}, {_scored('answer', 'gold_answer', 'conv_id, turn')}, "
    r"j AS (SELECT sc.* EXCLUDE (strategy), CASE WHEN contains(strategy, '->') THEN trim(string_split(strategy, '->')[2]) WHEN contains(strategy, 'Fallback') THEN 'Fallback' ELSE 'Unknown' END strategy, "
    r"CASE trim(regexp_extract(strategy, '\(([^,]+),', 1)) WHEN 'Relational' THEN 'Reasoning' WHEN 'Reasoning' THEN 'Reasoning' WHEN 'Retrieval' THEN 'Retrieval' WHEN 'Comparative' THEN 'Comparative' ELSE 'Default' END intent FROM sc)"
)


@query(f"WITH {JUDGED} SELECT conv_id, turn, intent, strategy, answer, em, contain, round(f1, 6) AS f1, round(prec, 6) AS prec, round(rec, 6) AS rec FROM j")
def score_answers(spark, d):
    """Every answer with its intent, strategy, exact and contained match, f1, precision and recall."""
    return _judged(spark, d).select("conv_id", "turn", "intent", "strategy", "answer", "em", "contain", F.round("f1", 6).alias("f1"), F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("rec"))


@query(f"WITH {JUDGED} SELECT intent, strategy, count(*) AS n, round(avg(em), 6) AS em, round(avg(contain), 6) AS contain, round(avg(f1), 6) AS f1, round(avg(prec), 6) AS prec, round(avg(rec), 6) AS rec FROM j GROUP BY GROUPING SETS ((), (intent), (strategy))")
def eval_grouping_sets(spark, d):
    rows = evaluate.report(_judged(spark, d), "intent", "strategy")
    return rows.select("intent", "strategy", "n", *[F.round(a, 6).alias(b) for a, b in (("em", "em"), ("contain", "contain"), ("f1", "f1"), ("precision", "prec"), ("recall", "rec"))])


@query(
    f"WITH {JUDGED}, g AS (SELECT 'all' kind, 'all' name, count(*) n, avg(em) em, avg(f1) f1 FROM j UNION ALL SELECT 'intent', intent, count(*), avg(em), avg(f1) FROM j GROUP BY intent UNION ALL SELECT 'strategy', strategy, count(*), avg(em), avg(f1) FROM j GROUP BY strategy), "
    "l(kind, name, place) AS (VALUES ('all', 'all', 0), ('intent', 'Retrieval', 0), ('intent', 'Reasoning', 1), ('intent', 'Comparative', 2), ('intent', 'Default', 3), "
    "('strategy', 'Agent-Zero-Shot', 0), ('strategy', 'Agent-Hop-1', 1), ('strategy', 'Agent-Hop-2', 2), ('strategy', 'Agent-Hop-3', 3), ('strategy', 'Fallback', 4)) "
    "SELECT kind, name, place, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM j), 6) AS share, round(em, 6) AS em, round(f1, 6) AS f1 FROM l FULL JOIN g USING (kind, name)"
)
def eval_report(spark, d):
    """The whole report: listed groups also without rows, others after them, each with its share (Fallback's is the fallback rate)."""
    rows = evaluate.full_report(_judged(spark, d))
    return rows.select("kind", "name", "place", "n", F.round("share", 6).alias("share"), F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"))


def _marks(low: str, marks: tuple[str, ...]) -> str:
    return " + ".join(f"contains({low}, '{m}')::INT" for m in marks)


@query(
    f"SELECT doc_id, CAST({_marks('lower(text)', intents.COMPARISONS)} + (starts_with(lower(text), 'compare ') OR starts_with(lower(text), 'rank '))::INT AS INTEGER) AS comparisons, CAST({_marks('lower(text)', intents.CLAUSES)} AS INTEGER) AS clauses, "
    "(length(text) - length(replace(lower(text), ' of ', ''))) // 4 + 0.5 * (length(text) - length(replace(text, '的', ''))) AS of_depth, round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 20.0, 6) AS length FROM documents"
)
def struct_features(spark, d):
    f = intents.structure(F.col("text"))
    return table(spark, d, "documents").select("doc_id", f["comparisons"].alias("comparisons"), f["clauses"].alias("clauses"), f["of_depth"].alias("of_depth"), F.round(f["length"], 6).alias("length"))


@query(
    "WITH p AS (SELECT event_id, (event_id % 7) / 10.0 + 0.1 p0, (event_id % 5) / 10.0 + 0.1 p1, (event_id % 3) / 10.0 + 0.1 p2 FROM events), "
    "m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 20 < 10 THEN p0 * 1.2 ELSE p0 END a, p1 b, CASE WHEN event_id % 3 = 0 THEN p2 * 0.1 ELSE p2 END c FROM p), "
    "q AS (SELECT event_id, a / (a + b + c) a, b / (a + b + c) b, c / (a + b + c) c FROM m), "
    "t AS (SELECT *, greatest(a, b, c) top, CASE WHEN greatest(a, b, c) < 0.6 THEN 'Default' WHEN a = greatest(a, b, c) THEN 'Retrieval' WHEN b = greatest(a, b, c) THEN 'Reasoning' ELSE 'Comparative' END intent FROM q) "
    "SELECT event_id, round(a, 6) AS p0, round(top, 6) AS top, intent, round(CASE intent WHEN 'Default' THEN 0.15 ELSE 0.10 * a + 0.15 * b + 0.10 * c END, 6) AS w_f, "
    "round(CASE intent WHEN 'Default' THEN 0.40 ELSE 0.40 * a + 0.30 * b + 0.25 * c END, 6) AS w_s, round(CASE intent WHEN 'Default' THEN 0.45 ELSE 0.50 * a + 0.55 * b + 0.65 * c END, 6) AS w_e FROM t"
)
def weight_modulation(spark, d):
    """Probabilities corrected by a question's structure, and the weights mixed by them."""
    i = F.col("event_id")
    m = intent.modulate((i % 7) / F.lit(10.0) + 0.1, (i % 5) / F.lit(10.0) + 0.1, (i % 3) / F.lit(10.0) + 0.1, i % 3, i % 2, i % 20)
    mixed = table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", "m", intent.mixed_weights(F.col("m")).alias("w"))
    return mixed.select("event_id", F.round("m.p0", 6).alias("p0"), F.round("m.top", 6).alias("top"), "m.intent", *[F.round(f"w.{c}", 6).alias(c) for c in ("w_f", "w_s", "w_e")])


@query("SELECT toxic, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY toxic")
def class_weights(spark, d):
    return intents.class_weights(table(spark, d, "labels"), "toxic").select("toxic", F.round("weight", 6).alias("weight"))


@query(
    "WITH c AS (SELECT quality AS label, count(*) n, 0 s, sum((quality = toxic)::INT) h FROM labels GROUP BY 1 UNION ALL SELECT toxic, 0, count(*), 0 FROM labels GROUP BY 1), g AS (SELECT label, sum(n) support, sum(s) said, sum(h) hits FROM c GROUP BY label) "
    "SELECT label, round(CASE WHEN said > 0 THEN hits / said ELSE 0 END, 6) AS prec, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 6) AS rec, round(CASE WHEN said + support > 0 THEN 2 * hits / (said + support) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM g"
)
def class_report(spark, d):
    rows = intents.class_report(table(spark, d, "labels"), "quality", "toxic")
    return rows.select("label", F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("rec"), F.round("f1", 6).alias("f1"), "support")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_safe_parse(spark, d):
    """Replies around the same value: fenced JSON, Python literals with chatter, a torn list, and nothing readable."""
    i, p = F.col("event_id"), F.col("props")
    reply = F.when(i % 4 == 0, F.concat(F.lit("```json\n["), p, F.lit(" "), p, F.lit("]\n```"))).when(i % 4 == 1, F.concat(F.lit("Sure: [​"), F.translate(p, '"', "'"), F.lit("] done"))).when(i % 4 == 2, F.concat(F.lit("["), p, F.lit(', {"torn": '))).otherwise("nothing here")
    rows = table(spark, d, "events").select("event_id", F.from_json(parsing.safe_json(reply), "array<struct<k:long>>").alias("v"))
    return rows.select("event_id", F.get("v", F.lit(0))["k"].alias("k"))


@query(
    "SELECT event_id, event_id % 3 = 0 AS is_final, CASE event_id % 6 WHEN 0 THEN 'v' || user_id WHEN 3 THEN 'no' ELSE '' END AS answer, CASE WHEN event_id % 3 = 1 THEN 'u' || user_id || '|B c' ELSE '' END AS relevant, "
    "CASE event_id % 3 WHEN 1 THEN 'Node ' || user_id || '|other' WHEN 2 THEN 'Node ' || user_id || '|other|third' ELSE '' END AS following FROM events"
)
def parse_decision(spark, d):
    """Replies as decisions: final answers, listed nodes matched to the scope by case and by likeness, and denials."""
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    reply = (
        F.when(i % 6 == 0, F.concat(F.lit("Thought.\nFinal Answer: **v"), u, F.lit("**.\n\nNext Hop: [x]")))
        .when(i % 6 == 3, F.lit("Final Answer: No, it is not"))
        .when(i % 3 == 1, F.concat(F.lit("Relevant Nodes: ['u"), u, F.lit('\'; - B c]\nNext Hop: ["node '), u, F.lit('"; othr; zzzz]')))
        .otherwise("Final Answer: not found")
    )
    scope = F.array(F.concat(F.lit("Node "), u), F.lit("other"), F.lit("third"), F.lit("fourth"))
    rows = table(spark, d, "events").select("event_id", parsing.parse_decision(reply, scope).alias("r"))
    return rows.select("event_id", "r.is_final", "r.answer", F.array_join("r.relevant_nodes", "|").alias("relevant"), F.array_join("r.next_nodes", "|").alias("following"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_type END AS matched FROM events")
def match_name(spark, d):
    """Names proposed for a scope: equal, other case, misspelt (doubled last letter), unknown."""
    i, t = F.col("event_id"), F.col("event_type")
    said = F.when(i % 4 == 0, t).when(i % 4 == 1, F.upper(t)).when(i % 4 == 2, F.concat(t, F.substring(t, -1, 1))).otherwise("0123456789")
    return table(spark, d, "events").select("event_id", parsing.match_name(said, F.array(F.lit("zz"), t)).alias("matched"))


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) || '|' || event_id ELSE CAST(event_id AS VARCHAR) END AS parts, CASE WHEN event_id % 10 < 7 THEN CAST(event_id % 10 AS VARCHAR) || ',' ELSE '' END || '3' AS chosen, "
    "CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'plain ' || event_type END AS tail FROM events"
)
def reply_parts(spark, d):
    """Numbers in a list of chunks, chosen indices below seven, and what follows the last final answer."""
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    chunks = F.when(F.col("event_id") % 3 == 0, F.concat(u, F.lit(" , x1, "), i)).otherwise(F.concat(F.lit("a,"), i, F.lit(",")))
    chosen = text.selected_indices(F.concat(F.lit("IDs "), (F.col("event_id") % 10).cast("string"), F.lit(", 3 and 99999999999")), F.lit(7))
    tail = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Final Answer: a Final Answer: "), "event_type")).otherwise(F.concat(F.lit("plain "), "event_type"))
    return table(spark, d, "events").select("event_id", F.array_join(text.numeric_parts(chunks), "|").alias("parts"), F.array_join(chosen, ",").alias("chosen"), text.after_marker(tail).alias("tail"))


@query(f"WITH e AS (SELECT l_orderkey, l_linenumber, md5('42|' || l_orderkey || '|' || l_linenumber) h FROM lineitem) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM e WHERE ('0x' || substr(h, 1, 7))::BIGINT / 268435456.0 >= 0.4")
def edge_mask(spark, d):
    """Line items that a mask of 0.4 leaves, the same at any partitioning."""
    return graph.mask_edges(table(spark, d, "lineitem"), 0.4, 42, "l_orderkey", "l_linenumber").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query(r"SELECT c_custkey, lower(regexp_replace(regexp_replace(trim(n), '(?i)\s+(Jr|Sr|Dr|Prof|King|Sultan|President|Queen|Princess)\b\.?', '', 'g'), '[^A-Za-z0-9]', '', 'g')) AS cleaned FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' || c_name || ' JR.' WHEN 1 THEN c_name || chr(9) || 'queen  of, x' WHEN 2 THEN 'Dr ' || c_name || ' sultanate' ELSE c_name END n FROM customer)")
def clean_entity(spark, d):
    """Names with titles in any case, tabs, and words that only begin like a title."""
    i, n = F.col("c_custkey") % 5, F.col("c_name")
    name = F.when(i == 0, F.concat(F.lit(" "), n, F.lit(" JR."))).when(i == 1, F.concat(n, F.lit("\tqueen  of, x"))).when(i == 2, F.concat(F.lit("Dr "), n, F.lit(" sultanate"))).otherwise(n)
    return table(spark, d, "customer").select("c_custkey", text.clean_entity(name).alias("cleaned"))


SUFFIXES = ("", " Jr.", " junior ", " SR", ", 1st", " ii", " III.", " iv", " V", " 5th", " jrx", " 2nd")


@query(
    "SELECT c_custkey, CASE c_custkey % 12 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 4 WHEN 8 THEN 5 WHEN 9 THEN 5 WHEN 11 THEN 2 END AS generation, "
    "coalesce((CASE c_custkey % 12 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 4 WHEN 8 THEN 5 WHEN 9 THEN 5 WHEN 11 THEN 2 END) <> 1, false) AS apart FROM customer"
)
def generation(spark, d):
    """The generation in a name's suffix, and whether it sets it apart from a senior."""
    name = F.concat("c_name", F.get(F.lit(list(SUFFIXES)), (F.col("c_custkey") % 12).cast("int")))
    return table(spark, d, "customer").select("c_custkey", text.generation(name).alias("generation"), persons.generations_apart(name, F.lit("Ed Wood Sr.")).alias("apart"))


@query(
    "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN substr(text, 1, 9) ELSE coalesce(nullif(array_to_string(list_filter(regexp_split_to_array(trim(substr(text, 1, 60)), '\\s+'), lambda w: regexp_matches(w, '^\\p{Lu}') OR (lower(w) NOT IN ("
    + ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    + ") AND length(w) > 2)), ' '), ''), substr(text, 1, 60)) END AS purified FROM benchmark"
)
def purify_query(spark, d):
    """Questions reduced to their quoted part, or to what is capitalised or telling."""
    t = F.substring("text", 1, 60)
    asked = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('say "'), F.substring("text", 1, 9), F.lit('" now'))).otherwise(t)
    return table(spark, d, "benchmark").select("item_id", text.purify_query(asked).alias("purified"))


@query(
    "SELECT p_partkey, trim(p_name) || CASE WHEN p_brand = trim(p_name) AND p_type = trim(p_name) THEN '' ELSE ', synonyms: ' || p_brand || ', ' || p_type END AS name, CASE p_type WHEN 'x' THEN 1.0 ELSE CASE p_partkey % 4 WHEN 0 THEN 0.05 WHEN 1 THEN 0.01 WHEN 2 THEN 0.08 ELSE 0.10 END END AS radius, "
    "CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_partkey + 0.5 END AS first, CASE WHEN p_partkey % 3 = 1 THEN 2 ELSE 3 END AS dim FROM part"
)
def entity_texts(spark, d):
    """Enriched names, radii by category, written vectors parsed and missing ones as zeros."""
    k = F.col("p_partkey")
    category = F.get(F.lit(["Person", "Time", "Concept", "Unheard of"]), (k % 4).cast("int"))
    written = F.when(k % 3 == 1, F.concat(F.lit("["), k, F.lit(".5,2]"))).when(k % 3 == 2, F.concat(F.lit("[ "), k, F.lit(".5, 2.0, -1e-3 ]")))
    v = vector.or_zeros(vector.parsed(written), 3)
    return table(spark, d, "part").select("p_partkey", text.enriched_name(F.col("p_name"), F.array("p_name", "p_brand", F.lit(""), "p_type")).alias("name"), radius_of(category).alias("radius"), F.get(v, F.lit(0)).alias("first"), F.size(v).alias("dim"))


@query("WITH a AS (SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_name))), ', ') s FROM customer GROUP BY 1) SELECT c_nationkey, CASE WHEN length(s) > 50 THEN substr(s, 1, 47) || '...' ELSE s END AS answer FROM a")
def joined_answers(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(corpora.joined_answers(F.col("c_name")).alias("answer"))


@query("SELECT * FROM (SELECT o_orderkey, 'first' AS part FROM orders ORDER BY o_orderkey LIMIT 25) UNION ALL SELECT * FROM (SELECT o_orderkey, 'last' FROM orders ORDER BY o_orderkey DESC LIMIT 25)")
def head_tail(spark, d):
    """A sample of questions from either end (the limit is the feature)."""
    o = table(spark, d, "orders").select("o_orderkey")
    return corpora.sample(o, 25, "o_orderkey").withColumn("part", F.lit("first")).unionByName(corpora.sample(o, 25, "o_orderkey", last=True).withColumn("part", F.lit("last")))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def category_filter(spark, d):
    """Training rows of the wanted kinds only."""
    return intents.of_kinds(table(spark, d, "events").select("event_id", "event_type"), "event_type", ("click", "view"))
