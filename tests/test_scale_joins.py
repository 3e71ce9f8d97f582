"""Joins that cut alike rows before they meet, against brute force, and the rows that meet."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketweave.lineage import ensure_checkpoint_dir, written
from ticketweave.operators import joins, matching, retrieval
from ticketweave.plans import q_joins, registry
from ticketweave.tables import Tables


def settled(spark, name):
    return {str(p) for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob(f"{name}-*")}


def test_log_records_are_cut_by_kind_before_clusters_meet_them(spark):
    rng = random.Random(4)
    clusters = [(i, f"t{rng.randrange(3)}.x", rng.choice(["a", "b", None]), f"text boom{rng.randrange(3)}", [f"E{rng.randrange(3)}", f"E{rng.randrange(9)}"]) for i in range(60)]
    clusters += [(60, None, "a", None, None), (61, "t1.y", "zz", "", ["E1"])]
    records = [(i, rng.choice(["Boom1", "BOOM2", "", None, "x"]), rng.choice(["t1.q", "t2.q", "", None]), rng.choice(["a", "c", None]), [f"e{rng.randrange(4)}", rng.choice(["E1", "e7"])], rng.choice([True, False, None])) for i in range(900)]
    points = {}
    for c, ct, ca, terms, cc in clusters:
        for r, e, rt, ra, rcodes, ok in records:
            s = 10 * bool(e and terms and e.lower() in terms) + 6 * bool(rt and ct and rt.split(".")[0] == ct.split(".")[0]) + 3 * (ra is not None and ra == ca)
            s += 4 * bool({x.lower() for x in cc or []} & {x.lower() for x in rcodes}) + 2 * bool(ok)
            if s:
                points.setdefault(c, []).append((-s, r))
    want = sorted((c, r, -s, n) for c, rows in points.items() for n, (s, r) in enumerate(sorted(rows)[:3], 1))
    cl = spark.createDataFrame(clusters, "cluster_id long, incident_type string, application string, terms string, codes array<string>").repartition(3)
    rc = spark.createDataFrame(records, "record_id long, exception string, incident_type string, application string, codes array<string>, validated boolean").repartition(3)
    ensure_checkpoint_dir(spark)
    before = settled(spark, "record-pairs")
    assert sorted(tuple(r) for r in joins.match_log_records(cl, rc, 3).select("cluster_id", "record_id", "score", "rank").collect()) == want
    made = settled(spark, "record-pairs") - before
    assert made and sum(spark.read.parquet(p).count() for p in made) < 62 * 100  # of 55,800


def test_hybrid_search_meets_a_name_once(spark, monkeypatch):
    seen = []
    plain = retrieval.phrase_hits
    monkeypatch.setattr(retrieval, "phrase_hits", lambda docs, *a: seen.append(docs.count()) or plain(docs, *a))
    q = spark.createDataFrame([("q1", "find ring"), ("q2", "some bolt"), ("q2", "some bolt"), ("q3", "nothing")], "q string, t string")
    docs = spark.createDataFrame([(i, n) for i in range(300) for n in ["Ring", "bolts"][i % 2:i % 2 + 1]], "id long, n string")
    sem = spark.createDataFrame([("q1", 1, 0.4), ("q2", 3, 0.2), ("q2", 2, 0.9), ("q3", 5, 0.1)], "q string, id long, score double")
    got = sorted(tuple(r) for r in retrieval.hybrid_search(q, docs, "q", "t", "id", "n", sem, 4).select("q", "rank", "id", "score", "match_type").collect())
    want = [("q1", i + 1, 2 * i, 1.0, "exact") for i in range(4)] + [("q2", i + 1, 2 * i + 1, 0.9, "fuzzy_keyword") for i in range(4)] + [("q3", 1, 5, 0.1, "semantic")]
    assert got == want
    assert seen == [2]


def test_similar_pairs_bring_sets_in_for_near_pairs_only(spark):
    """Against brute force, with copies and null keys; pairs of long sets that share one rare word are no pairs."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    rows = [(i, rng.sample(words, rng.randint(1, 9))) for i in range(120)]
    rows += [(200 + i, [f"{i}_{j}" for j in range(30)] + ["rare"]) for i in range(20)] + [(300 + i, rows[i][1]) for i in range(30)] + [(400, []), (401, None), (None, ["w1"])]
    df = spark.createDataFrame(rows, "id long, t array<string>").repartition(3)
    asked = df.filter("id % 5 = 0")
    for measure, size in (("overlap", lambda a, b: max(len(a), len(b))), ("jaccard", lambda a, b: len(a | b))):
        sets = {i: set(t) for i, t in rows if i is not None and t}
        want = sorted((i, j, round(len(a & b) / size(a, b), 9)) for i, a in sets.items() for j, b in sets.items() if len(a & b) / size(a, b) >= 0.6)
        ensure_checkpoint_dir(spark)
        before = settled(spark, "scored")
        got = sorted((r.l, r.r, round(r.score, 9)) for r in matching.similar_pairs(df, df, "id", "id", "t", 0.6, measure).collect())
        assert got == want
        made = settled(spark, "scored") - before
        assert made and sum(spark.read.parquet(p).count() for p in made) < len(want) / 2  # copies are compared once
        got = sorted((r.l, r.r, round(r.score, 9)) for r in matching.similar_pairs(asked, df, "id", "id", "t", 0.6, measure).collect())
        assert got == [w for w in want if w[0] % 5 == 0]


def tables(spark, scratch, **given):
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{scratch}/{name}.parquet")
    con = duckdb.connect()
    for name in given:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{scratch}/{name}.parquet/*.parquet'")
    return con


def same_as_twin(spark, scratch, con, name):
    """Rows of the query, which its SQL twin has as well, however often they come."""
    df = registry.all_queries()[name](spark, scratch)
    cur = con.execute(registry.all_sql()[name])
    cols = [d[0] for d in cur.description]
    plain = lambda row: tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in row)
    got = sorted(plain(r) for r in df.select(*cols).collect())
    assert got == sorted(plain(r) for r in cur.fetchall())
    return df.collect()


def test_every_link_comes_out(spark, scratch):
    """j01: all pairs of clusters and records, each once, with copies and keys that come twice; no pairs of classes."""
    con = tables(spark, scratch, supplier=([(i % 70, i % 4) for i in range(72)], "s_suppkey long, s_nationkey long"), part=([(i % 88, i % 9) for i in range(90)], "p_partkey long, p_size long"))
    rows = same_as_twin(spark, scratch, con, "j01_link_clusters")
    given = Tables(spark, scratch)
    want = {(c.cluster_id, r.record_id) for c in q_joins.clusters(given).collect() for r in q_joins.records(given).collect()
            if (c.incident_type and c.incident_type == r.incident_type) or set(c.codes) & {x.upper() for x in r.codes}}
    assert sorted((r.cluster_id, r.record_id) for r in rows) == sorted(want)


EVENTS = ([(i % 58, i % 9, "click") for i in range(60)] + [(100, 7, "click")] * 2, "event_id long, user_id long, event_type string")
PARTS = ([(i, ["red thing a", "small economy b", "blue ring c"][i % 3], "T X", i % 8) for i in range(40)] + [(50, "red thing a", "T X", 3)] * 2, "p_partkey long, p_name string, p_type string, p_size int")


@pytest.mark.parametrize("name", ["j13_match_procedures", "j13_match_procedures_weak"])
def test_every_match_comes_out(spark, scratch, name):
    """j13: all pairs of questions and procedures, also of rows that come twice; no pairs of classes."""
    rows = same_as_twin(spark, scratch, tables(spark, scratch, events=EVENTS, part=PARTS), name)
    assert len(rows) > 400 and len([r for r in rows if r.qid == 100]) >= 10


def documents(n=90):
    rng = random.Random(3)
    texts = [" ".join(rng.sample([f"w{k}" for k in range(40)], rng.randint(8, 20))) for _ in range(n // 3)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.upper()) for i, t in enumerate(texts)]
    return rows + [(200 + i, f"{t} new") for i, t in enumerate(texts)] + [(300, None), (301, " "), rows[0]]


def test_every_similar_pair_comes_out(spark, scratch):
    """j17: all pairs of documents, copies among them; no pairs of classes."""
    docs = documents()
    rows = same_as_twin(spark, scratch, tables(spark, scratch, documents=(docs, "doc_id long, text string")), "j17_similar_pairs")
    sets = [(i, set(t.lower().split())) for i, t in docs if t and t.split()]
    want = sorted((i, j, round(len(a & b) / max(len(a), len(b)), 6)) for i, a in sets for j, b in sets if i < j and len(a & b) / max(len(a), len(b)) >= 0.8)
    assert len(want) >= 90 and sorted((r.a, r.b, r.score) for r in rows) == want


def test_every_document_asks_for_similar_issues(spark, scratch):
    """r07: each document is a question and each is a past issue."""
    docs = [(i, t) for i, t in documents()[:-1] if t != " "]  # the twin divides by none for two empty texts
    rows = same_as_twin(spark, scratch, tables(spark, scratch, documents=(docs, "doc_id long, text string")), "r07_similar_issues")
    assert {r.qid for r in rows} == {i for i, _ in docs}
    assert all(len([r for r in rows if r.qid == i and r.source == "diagnostics"]) >= 3 for i in range(30))


def test_nodes_of_a_dense_neighbourhood_travel_a_few_times(spark):
    """Near copies make pairs with the square of their number; what is brought in for them does not."""
    pairs = spark.range(400).join(spark.range(400).withColumnRenamed("id", "r"), F.col("id") < F.col("r")).select(F.col("id").alias("l"), "r")
    far = spark.range(1000, 1100).select(F.col("id").alias("l"), (F.col("id") + 1000).alias("r"))
    given = spark.range(3000).select(F.col("id").alias("node"))

    def look(asked, brought):
        held = set(brought.column("node").to_pylist())
        return pa.table({"pairs": [asked.num_rows], "brought": [brought.num_rows], "ok": [held == {*asked.column("l").to_pylist(), *asked.column("r").to_pylist()}]})

    weights = given.select("node", F.lit(1).alias("weight"))
    rows = matching._together(pairs.unionByName(far), given, look, "pairs long, brought long, ok boolean", weights, 128, "looked").collect()
    assert all(r.ok for r in rows) and len(rows) > 2
    assert sum(r.pairs for r in rows) == 400 * 399 // 2 + 100 and sum(r.brought for r in rows) < 6000  # of 159,800 ends


def test_near_copies_and_long_sets_against_brute_force(spark):
    """Many sets that differ in a word, words that most sets hold, and words that stand for themselves only within ``on``."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(20)]
    rows = [(i, i % 2, base + [f"own{i}"]) for i in range(90)] + [(100 + i, i % 2, base[:rng.randint(10, 20)] + [f"x{rng.randrange(5)}"]) for i in range(60)]
    rows += [(200 + i, None, base) for i in range(3)] + [(300, 0, [f"l{i}" for i in range(3000)]), (301, 0, [f"l{i}" for i in range(2500)])]
    df = spark.createDataFrame(rows, "id long, at int, t array<string>").repartition(3)
    for measure, size in (("overlap", lambda a, b: max(len(a), len(b))), ("jaccard", lambda a, b: len(a | b))):
        sets = [(i, at, set(t)) for i, at, t in rows]
        share = lambda a, b: len(a & b) / size(a, b)
        want = sorted((i, j, round(share(a, b), 9)) for i, x, a in sets for j, y, b in sets if x is not None and x == y and share(a, b) >= 0.8)
        assert sorted((r.l, r.r, round(r.score, 9)) for r in matching.similar_pairs(df, df, "id", "id", "t", 0.8, measure, ("at",)).collect()) == want
        want = sorted((i, j, round(share(a, b), 9)) for i, x, a in sets for j, y, b in sets if i < 120 and share(a, b) >= 0.8)
        assert sorted((r.l, r.r, round(r.score, 9)) for r in matching.similar_pairs(df.filter("id < 120"), df, "id", "id", "t", 0.8, measure).collect()) == want


def test_written_tables_leave_no_shuffle_behind(spark):
    files = lambda: [f for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data")]
    before = set(files())
    df = written(spark.range(5000).repartition(7).groupBy(F.col("id") % 100).count(), "swept")
    assert not set(files()) - before
    assert df.count() == 100


def test_top_terms_send_no_rows_of_documents(spark):
    """r02's operator against brute force, with a key that comes twice, one that two groups share, nulls and texts without terms."""
    rng = random.Random(2)
    rows = [(f"g{i % 3}", i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta_x", "the", "zz", "Épsilon"], k=rng.randint(0, 9)))) for i in range(60)]
    rows += [rows[4], rows[4], ("g2", rows[4][1], "alpha omega"), ("g1", None, "omega beta"), ("g1", None, "omega beta"), ("g0", 99, None), ("g0", 98, "")]
    docs = {}
    words = [(g, k, [w for w in re.findall(r"[^\W\d]{3,}", (t or "").lower()) if w != "the"]) for g, k, t in rows]
    for g, k, ws in words:
        for w in ws:
            docs.setdefault((g, k, len(ws)), Counter())[w] += 1
    sums, df = {}, Counter()
    for (g, _, dl), ws in docs.items():
        for w, c in ws.items():
            sums[g, w] = sums.get((g, w), 0) + c / dl
            df[w] += 1
    sizes = Counter(g for g, _, _ in rows)
    scored = {}
    for (g, w), s in sums.items():
        scored.setdefault(g, []).append((-round(s * math.log(len(rows) / df[w]) / sizes[g], 6), w))
    want = sorted((g, w, round(-s, 6), n) for g, x in scored.items() for n, (s, w) in enumerate(sorted(x)[:4], 1))
    found = retrieval.top_terms(spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(3), "source", "doc_id", "text", 4, stop=("the",))
    assert sorted((r.source, r.term, round(r.score, 6), r["rank"]) for r in found.collect()) == want
    unique = [r for i, r in enumerate(rows[:60])]
    plan = retrieval.top_terms(spark.createDataFrame(unique, "source string, doc_id long, text string"), "source", "doc_id", "text", 4)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "doc_id" in x]


def test_grams_are_numbers_of_code_points(spark):
    """Grams come from one pass over code points, and phrases of any length are found by them."""
    from ticketweave.operators.matching import grams_of, phrase_hits

    text = "a\U0001f600bcabca" * 3
    assert len(grams_of(text, 4)) == len({text[i:i + 4] for i in range(len(text) - 3)}) and len(grams_of("abc", 4)) == len(grams_of(None, 1)) == 0
    texts = [(1, "Port 12 is \U0001f600 down"), (2, None), (3, ""), (4, "por"), (5, "a port"), (6, "é é\nport 1")]
    phrases = ["port", "PORT 12", "o", "\U0001f600", "\U0001f600 do", "é\np", "12 i", None, "", "none of it", "or"]
    docs = spark.createDataFrame(texts, "k int, t string")
    got = phrase_hits(docs, "k", "t", spark.createDataFrame([(p,) for p in phrases], "p string"), "p")
    want = {(k, p.lower()) for k, t in texts for p in phrases if t and p and p.lower() in t.lower()}
    assert sorted((r["k"], r["phrase"]) for r in got.collect()) == sorted(want)
