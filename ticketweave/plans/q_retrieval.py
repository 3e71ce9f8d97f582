"""Retrieval and ML queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave import fixed_values as fv
from ticketweave.lineage import written
from ticketweave.operators import calibration as cal, evaluation as ev, extract as ex, features as ft, retrieval as rt
from ticketweave.plans.q_joins import clusters, records
from ticketweave.plans.q_rollups import tickets
from ticketweave.plans.q_text import DOCS_SCORED_SQL, scored_documents
from ticketweave.plans.registry import query
from ticketweave.plans.sqlkit import any_in, case, items

C, L = F.col, F.lit
S = lambda c: c.cast("string")


@query("r01_tfidf")
def _(t):
    from pyspark.ml.functions import vector_to_array
    df = rt.tfidf(t.documents, "text", 2000, 2)
    return df.select("doc_id", F.size(F.filter(vector_to_array("features"), lambda x: x > 0)).alias("n_terms"))


_WEIGHTS_SQL = """n AS (SELECT count(*) AS docs FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
v AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 5000),
w AS (SELECT doc_id, term, tf, df, TF_WEIGHT * (ln((1.0 + docs) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term), n),
x AS (SELECT doc_id, term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@query("r01_word_weights", f"""WITH words AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{fv.ACCENTS_FROM}', '{fv.ACCENTS_TO}'), '[\\p{{L}}\\p{{N}}_-]{{2,}}') AS w FROM documents),
terms AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
{_WEIGHTS_SQL.replace("TF_WEIGHT", "(1 + ln(tf))")},
r AS (SELECT doc_id, term, tf, df, round(weight, 6) AS weight FROM x)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM r QUALIFY rank <= 20""")
def _(t):
    return ft.heaviest_terms(ft.term_weights(t.documents, "doc_id", "text"), "doc_id", 20)


@query("r01_char_weights", f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM documents),
padded AS (SELECT doc_id, ' ' || w || ' ' AS w FROM words),
sized AS (SELECT doc_id, w, unnest(range(3, greatest(3, least(5, length(w))) + 1)) AS k FROM padded),
terms AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(w) - k + 1, 1) + 1), lambda i: substr(w, i, k))) AS term FROM sized),
{_WEIGHTS_SQL.replace("TF_WEIGHT", "tf")}
SELECT term, min(df) AS df, sum(tf)::BIGINT AS total, round(sum(weight), 4) AS weight FROM x GROUP BY 1""")
def _(t):
    weights = ft.term_weights(t.documents, "doc_id", "text", ft.char_terms, sublinear=False)
    return weights.groupBy("term").agg(F.min("df").alias("df"), F.sum("tf").alias("total"), F.round(F.sum("weight"), 4).alias("weight"))


@query("r01_char_ngrams", "SELECT s_suppkey, list_count(g)::INTEGER AS n FROM (SELECT s_suppkey, flatten([list_transform(range(1, length(s_name) - 1), lambda i: substr(s_name, i, 3)), list_transform(range(1, length(s_name) - 2), lambda i: substr(s_name, i, 4)), list_transform(range(1, length(s_name) - 3), lambda i: substr(s_name, i, 5))]) AS g FROM supplier)")
def _(t):
    return t.supplier.select("s_suppkey", F.size(rt.char_ngrams(C("s_name"))).alias("n"))


_TT = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}_]{{3,}}'), lambda w: w NOT IN ({items(fv.KEYWORD_STOP_WORDS)}))"


@query("r02_top_terms", f"""WITH k AS (SELECT source, doc_id, {_TT} AS ts FROM documents), e AS (SELECT source, doc_id, len(ts) AS dl, unnest(ts) AS term FROM k), tf AS (SELECT source, doc_id, term, count(*) / any_value(dl) AS w FROM e GROUP BY 1, 2, 3), g AS (SELECT source, term, sum(w) AS w FROM tf GROUP BY 1, 2),
i AS (SELECT term, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY 1), z AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT source, term, round(w * idf / n, 6) AS score FROM g JOIN i USING (term) JOIN z USING (source))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term)::INTEGER AS rank FROM s) WHERE rank <= 8""")
def _(t):
    return rt.top_terms(t.as_filed("documents"), "source", "doc_id", "text", 8)


_BM = """WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9_]{3,}')) AS ts FROM documents), st AS (SELECT count(*) AS n, greatest(1.0, avg(len(ts))) AS avg FROM d), tf AS (SELECT doc_id, term, len AS dl, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9_]{3,}'))) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)"""


@query("r03_bm25", _BM + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 5")
def _(t):
    return rt.bm25(t.documents, t.benchmark, "doc_id", "text", "item_id", "text", 5)


_BOOST = "(SELECT DISTINCT item_id, lower(w) AS phrase FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS w FROM benchmark))"


@query("r03_bm25_entity_rerank", _BM + f", p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM s) WHERE rk <= 10), b AS (SELECT p.item_id, p.doc_id, round(any_value(p.score) + 0.2 * count(o.phrase), 6) AS score FROM p JOIN documents d USING (doc_id) LEFT JOIN {_BOOST} o ON o.item_id = p.item_id AND contains(lower(d.text), o.phrase) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b) WHERE rank <= 5")
def _(t):
    boosts = t.benchmark.select("item_id", F.explode(F.regexp_extract_all("text", L("[A-Za-z]{8,}"), L(0))).alias("phrase"))
    return rt.bm25(t.documents, t.benchmark, "doc_id", "text", "item_id", "text", 5, boosts=boosts)


_KNN = "(SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 25 = 0)"


@query("r04_knn", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM {_KNN}) WHERE rank <= 5 AND score >= 0.1")
def _(t):
    return rt.knn(t.embeddings, t.embeddings.filter("vec_id % 25 = 0"), "vec_id", "embedding", "vec_id", 5, 0.1)


@query("r04_knn_blocked", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM {_KNN}) WHERE rank <= 5")
def _(t):
    return rt.knn(t.embeddings, t.embeddings.filter("vec_id % 25 = 0"), "vec_id", "embedding", "vec_id", 5, pivots=7, block_bytes=64 << 10)


@query("r05_hybrid_search", """WITH q AS (SELECT DISTINCT p_brand AS qid, unnest(regexp_extract_all(lower(concat(p_brand, ' ', p_type, CASE WHEN p_size > 25 THEN ' widget' ELSE '' END)), '[\\p{L}\\p{N}_]{3,}')) AS w FROM part), d AS (SELECT p_partkey AS id, lower(split_part(p_name, ' ', 2)) AS name FROM part),
e AS (SELECT DISTINCT qid, id FROM q JOIN d ON name = w), f AS (SELECT DISTINCT qid, id FROM q JOIN d ON length(w) >= 4 AND contains(name, w) WHERE qid NOT IN (SELECT qid FROM e)), s AS (SELECT DISTINCT p_brand AS qid, p_partkey % 200 AS id, (p_partkey % 200) / 1000 AS score FROM part),
u AS (SELECT qid, id, 1.0::DOUBLE AS score, 'exact' AS match_type, 0 AS tier FROM e UNION ALL SELECT qid, id, 0.9, 'fuzzy_keyword', 1 FROM f UNION ALL SELECT qid, id, score, 'semantic', 2 FROM s), m AS (SELECT qid, id, first(struct_pack(t := tier, s := score, m := match_type) ORDER BY tier, score DESC) AS x FROM u GROUP BY 1, 2)
SELECT qid, id, round(x.s, 6) AS score, x.m AS match_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x.t, x.s DESC, id)::INTEGER AS rank FROM m) WHERE rank <= 6""")
def _(t):
    q = t.part.select(C("p_brand").alias("qid"), F.concat_ws(" ", "p_brand", "p_type", F.when(C("p_size") > 25, "widget")).alias("text"))
    d = t.part.select(C("p_partkey").alias("id"), F.split_part("p_name", L(" "), L(2)).alias("name"))
    s = t.part.select(C("p_brand").alias("qid"), (C("p_partkey") % 200).alias("id"), (C("p_partkey") % 200 / 1000).alias("score")).distinct()
    return rt.hybrid_search(q, d, "qid", "text", "id", "name", s, 6)


_FA = lambda e: f"translate(lower({e}), '{fv.ACCENTS_FROM}', '{fv.ACCENTS_TO}')"
_FW = lambda e: f"list_distinct(regexp_extract_all({_FA(e)}, '[\\p{{L}}\\p{{N}}_]{{3,}}'))"


@query("r06_keyword_search", f"""WITH q AS (SELECT item_id, list_filter({_FW('text')}, lambda w: w NOT IN ({items(rt.SEARCH_STOP)})) AS qw FROM benchmark), d AS (SELECT doc_id, {_FW("concat(left(text, 80), ' ', text)")} AS dw, {_FW('left(text, 80)')} AS tw FROM documents),
s AS (SELECT item_id, doc_id, round(len(list_intersect(qw, dw)) / len(qw) + 0.15 * len(list_intersect(qw, tw)), 6) AS s FROM q, d WHERE len(qw) > 0 AND len(list_intersect(qw, dw)) > 0) SELECT item_id, doc_id, least(s, 0.95) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id)::INTEGER AS rank FROM s WHERE s >= 0.15) WHERE rank <= 5""")
def _(t):
    docs = t.documents.select("doc_id", F.substring("text", 1, 80).alias("title"), "text")
    return rt.keyword_search(t.benchmark, docs, "item_id", "text", "doc_id", "title", "text", 5)


_TS = lambda e: f"list_distinct(list_filter(regexp_split_to_array(lower({e}), '\\s+'), lambda w: w <> ''))"


@query("r07_similar_issues", f"""WITH q AS (SELECT doc_id AS qid, {_TS('text')} AS a FROM documents), h AS (SELECT doc_id, {_TS('text')} AS b FROM documents), p AS (SELECT qid, doc_id, len(list_intersect(a, b)) AS i, len(a) + len(b) AS n FROM q JOIN h ON len(a) >= 0.6 * len(b) AND len(b) >= 0.6 * len(a)),
r AS (SELECT qid, doc_id, round(i / (n - i), 6) AS score, 'diagnostics' AS source FROM p WHERE i / (n - i) > 0.6 UNION ALL SELECT doc_id, doc_id + 1, 0.5, 'history' FROM documents) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, source)::INTEGER AS rank FROM r) WHERE rank <= 10""")
def _(t):
    d = t.documents.select(C("doc_id").alias("qid"), "text")
    vec = t.read("documents").select(C("doc_id").alias("qid"), (C("doc_id") + 1).alias("doc_id"), L(0.5).alias("score"))
    return rt.similar_issues(d, None, "qid", "doc_id", "text", vec)


@query("r08_cluster_tickets")
def _(t):
    return rt.cluster_tickets(t.documents.select("doc_id", "text"), "text").groupBy("cluster_id").agg(F.count("*").alias("size"))


@query("r09_classifier")
def _(t):
    df = t.documents.select("doc_id", "text", "lang")
    model, test = rt.train_classifier(df, "text", "lang", "doc_id", max_features=1000)
    probs = rt.predict(model, test, "doc_id").join(test.select("doc_id", "lang"), "doc_id")
    best = probs.groupBy("doc_id", "lang").agg(F.max_by("label", "probability").alias("predicted"))
    return best.groupBy("lang", "predicted").agg(F.count("*").alias("n"))


@query("r09_calibration")
def _(t):
    """Calibration error and accuracy on held-out documents, before and after the curves."""
    df = t.documents.join(t.labels.select("doc_id", S(C("quality")).alias("label")), "doc_id").select("doc_id", "text", "label")
    held = F.pmod(F.xxhash64(S(C("doc_id"))), L(1000)) < 200
    plain, test = rt.train_classifier(df, "text", "label", "doc_id", max_features=1000)
    fitted = cal.train_calibrated(df.filter(~held), "text", "label", "doc_id", max_features=1000)
    truth = test.select("doc_id", C("label").alias("truth"))
    out = []
    for stage, probs in (("before", rt.predict(plain, test, "doc_id")), ("after", cal.predict_calibrated(fitted, test, "doc_id"))):
        best = probs.groupBy("doc_id").agg(F.max(F.struct("probability", "label")).alias("b")).join(truth, "doc_id")
        best = written(best.select(C("b.probability").alias("p"), (C("b.label") == C("truth")).alias("ok")), "predicted")
        out.append(ev.ece(best, "p", C("ok")).crossJoin(best.agg(F.count("*").alias("n"), F.round(F.avg(C("ok").cast("double")), 6).alias("accuracy"))).withColumn("stage", L(stage)))
    return out[0].unionByName(out[1])


@query("r12_l2_models")
def _(t):
    df = t.documents.select("doc_id", "text", "lang", (C("doc_id") % 2).cast("string").alias("half"))
    model = rt.train_l2(df, "text", "lang", "half", "doc_id")
    return rt.predict_l2(model, df, "doc_id", "lang").groupBy("level_1", "label").agg(F.count("*").alias("n"))


_HB = {l: " + ".join(f"CASE WHEN contains(lower(txt), '{k}') THEN {w} ELSE 0 END" for k, b, _, w in fv.KEYWORD_SIGNALS if b == l) for l in dict.fromkeys(s[1] for s in fv.KEYWORD_SIGNALS)}
_HK = " UNION ALL ".join(f"SELECT qid, '{l}' AS l1, ({e})::DOUBLE AS w FROM q" for l, e in _HB.items())


@query("r11_hier_predict", f"""WITH q AS (SELECT vec_id AS qid, embedding, concat(CASE vec_id % 3 WHEN 0 THEN 'vlan script' WHEN 1 THEN 'login bug 1300' ELSE 'nothing' END) AS txt FROM embeddings WHERE vec_id % 10 = 0), tr AS (SELECT * FROM embeddings WHERE vec_id % 10 > 0),
n AS (SELECT * FROM (SELECT qid, label::VARCHAR AS l1, round(list_cosine_similarity(q.embedding::DOUBLE[], tr.embedding::DOUBLE[]), 6) AS s, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], tr.embedding::DOUBLE[]), 6) DESC, vec_id) AS rn FROM q, tr) WHERE rn <= 5),
v AS (SELECT qid, l1, sum(s) AS s, count(*) AS c FROM n GROUP BY 1, 2), tp AS (SELECT qid, max(s) AS top, sum(s) AS total, count(*) AS n FROM n GROUP BY 1), kw AS ({_HK}), kt AS (SELECT qid, sum(w) AS tw FROM kw GROUP BY 1), ks AS (SELECT qid, l1, w / tw AS share FROM kw JOIN kt USING (qid) WHERE w > 0),
b AS (SELECT coalesce(v.qid, ks.qid) AS qid, coalesce(v.l1, ks.l1) AS l1, s, c, share FROM v FULL JOIN ks ON v.qid = ks.qid AND v.l1 = ks.l1), h AS (SELECT b.qid, b.l1, round(0.60 * coalesce(s, 0) / CASE WHEN total = 0 THEN 1 ELSE total END + 0.40 * coalesce(share, 0), 6) AS h, coalesce(c, 0) / greatest(n, 1) AS agree, top FROM b JOIN tp ON tp.qid = b.qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h DESC, l1) AS rn FROM h), f AS (SELECT r.*, least(tw, 1.0) AS boost, round(0.40 * top + 0.35 * agree + 0.25 * least(tw, 1.0), 4) AS conf FROM r JOIN kt USING (qid) WHERE rn = 1)
SELECT qid, l1 AS level_1, conf AS level_1_confidence, round(agree, 4) AS neighbor_agreement, round(boost, 4) AS keyword_boost, CASE WHEN conf >= 0.75 THEN 'HIGH' WHEN conf >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM f""")
def _(t):
    k = C("vec_id")
    q = t.embeddings.filter("vec_id % 10 = 0").select(k.alias("qid"), "embedding", F.when(k % 3 == 0, "vlan script").when(k % 3 == 1, "login bug 1300").otherwise("nothing").alias("txt"))
    return rt.hier_predict(q, t.embeddings.filter("vec_id % 10 > 0"), "qid", "embedding", "vec_id", "label", "txt")


_PAT_SQL = "(SELECT o_orderkey AS id, concat('c', o_custkey) AS entity, o_orderkey % 9 AS visits, o_orderkey % 5 AS ok, o_orderkey % 4 AS ko, o_orderdate AS created, o_totalprice / 600000 AS score FROM orders)"
_AGE = "date_diff('day', created::DATE, DATE '1998-12-31')"


def patterns(t):
    k = C("o_orderkey")
    return t.orders.select(k.alias("id"), F.concat(L("c"), S(C("o_custkey"))).alias("entity"), (k % 9).alias("visits"), (k % 5).alias("ok"), (k % 4).alias("ko"), C("o_orderdate").alias("created"), (C("o_totalprice") / 600000).alias("score"))


_PS = f"round(least(0.85::DOUBLE + 0.02 * visits, 0.95) * CASE WHEN {_AGE} > 60 THEN 0.80 WHEN {_AGE} > 30 THEN 0.85 WHEN {_AGE} > 14 THEN 0.92 ELSE 1.0 END::DOUBLE * CASE WHEN ok + ko > 0 THEN CASE WHEN ok / (ok + ko) < 0.6 THEN 0.70 ELSE 1.0 END ELSE 0.90 END::DOUBLE, 4)"


@query("r13_pattern_score", f"SELECT id, {_PS} AS score FROM {_PAT_SQL}")
def _(t):
    return patterns(t).select("id", rt.pattern_score(C("visits"), C("ok"), C("ko"), C("created"), L("1998-12-31").cast("timestamp")).alias("score"))


@query("r14_decay_patterns", f"SELECT id, round(n, 4) AS new_score FROM (SELECT id, score * CASE WHEN {_AGE} > 14 THEN 0.98 ELSE 1 END::DOUBLE * CASE WHEN {_AGE} > 60 THEN 0.90 ELSE 1 END::DOUBLE AS n FROM {_PAT_SQL}) WHERE n >= 0.20")
def _(t):
    return rt.decay_patterns(patterns(t).withColumn("used", L(None).cast("timestamp")), "score", "created", "used", L("1998-12-31").cast("timestamp")).select("id", "new_score")


@query("r15_patterns_for_entities", f"""WITH p AS (SELECT upper(entity) AS e, id, {_PS} AS s FROM {_PAT_SQL}), b AS (SELECT e, id, s FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY s DESC, id) rn FROM p) WHERE rn <= 3), w AS (SELECT c_nationkey AS grp, concat('C', c_custkey) AS e FROM customer)
SELECT * FROM (SELECT grp, id, s AS score, row_number() OVER (PARTITION BY grp ORDER BY s DESC, id)::INTEGER AS rank FROM (SELECT DISTINCT grp, id, s FROM w JOIN b USING (e))) WHERE rank <= 5""")
def _(t):
    p = patterns(t).withColumn("score", rt.pattern_score(C("visits"), C("ok"), C("ko"), C("created"), L("1998-12-31").cast("timestamp")))
    w = t.customer.select(C("c_nationkey").alias("grp"), F.concat(L("client:c"), S(C("c_custkey"))).alias("entity"))
    return rt.patterns_for_entities(p, w, "entity", "grp", "score", "id")


_TK = "(SELECT DISTINCT n_nationkey AS qid, unnest(CASE n_nationkey % 3 WHEN 0 THEN ['small', 'eco'] WHEN 1 THEN ['ring', 'brand'] ELSE ['widget', 'x', 'red'] END) AS w FROM nation)"


@query("r16_score_nodes", f"""WITH n AS (SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS m, lower(split_part(p_name, ' ', 2)) AS e, lower(p_brand) AS x, lower(p_type) AS o, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS lw FROM part), h AS (SELECT qid, id, lw, CASE WHEN contains(m, w) THEN 5 WHEN contains(e, w) THEN 4 WHEN contains(x, w) THEN 3 WHEN contains(o, w) THEN 2 ELSE 1 END AS p FROM {_TK}, n WHERE contains(concat_ws(' ', m, e, o, x, 'fix'), w)),
s AS (SELECT qid, id, (sum(p) + any_value(lw))::BIGINT AS score FROM h GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM s WHERE score >= 2) WHERE rank <= 6""")
def _(t):
    k = C("n_nationkey")
    q = t.nation.select(k.alias("qid"), F.when(k % 3 == 0, "small eco").when(k % 3 == 1, "ring brand").otherwise("widget x red").alias("text"))
    z = C("p_size")
    n = t.part.select(C("p_partkey").alias("id"), F.split_part("p_name", L(" "), L(1)).alias("method"), F.split_part("p_name", L(" "), L(2)).alias("entity"), C("p_brand").alias("exceptions"), C("p_type").alias("operation"), L("fix").alias("other"),
                      F.when(z % 4 == 0, "service").when(z % 4 == 1, "repository").when(z % 4 == 2, "controller").otherwise("util").alias("layer"))
    return rt.score_nodes(q, n, "qid", "text", "id", "method", "entity", "exceptions", "operation", "other", "layer")


@query("r17_chunk_procedures", " UNION ALL ".join(f"SELECT ticket_id, concat(ticket_id, '_{s}') AS chunk_id, '{s}' AS section, concat(application, chr(10), {c}) AS content FROM $tickets WHERE length(trim({c})) >= 1" for s, c in (("symptoms", "resume"), ("cause", "cause"), ("resolution", "solution"))))
def _(t):
    return ex.chunk_procedures(t.tickets, "ticket_id", "application", {"symptoms": "resume", "cause": "cause", "resolution": "solution"})


@query("r18_generate_procedures")
def _(t):
    from ticketweave.operators.joins import match_log_records
    c = clusters(t).withColumns({"cluster_name": F.concat(L("panne_"), S(C("cluster_id"))), "size": C("cluster_id") % 40, "trust_score": L(0.65)})
    r = records(t).withColumns({"error_pattern": F.concat(L("code "), C("exception")), "frequency": C("record_id") % 50, "probable_root_cause": F.concat(L("cause "), S(C("record_id") % 7))})
    out = rt.generate_procedures(c, r, match_log_records(c, r, 3), 0.45)
    return out.withColumns({"symptoms": F.array_join("symptoms", "|"), "root_causes": F.array_join("root_causes", "|")})


_CC = case([(any_in("lower(concat(source, ' ', text))", w), f"'{n}'") for n, w in rt.CANDIDATE_CATEGORIES], "'Général'")


@query("r19_build_candidates", f"SELECT doc_id, source, {_CC} AS category, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS trust_level, score AS stored_score FROM {DOCS_SCORED_SQL} WHERE score >= 30")
def _(t):
    return rt.build_candidates(scored_documents(t), "doc_id", "source", "text", "score")
