"""Operators on small literals, against brute force where SQL has no short form."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketweave.functions import logs, scores, text as tx
from ticketweave.operators import evaluation, extract, graph, joins, matching, ordered, retrieval, rollups, rules, windows
from ticketweave.sources import readers, sinks

C, L = F.col, F.lit


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("group_links", [joins.GROUP_LINKS, 30, 0])
def test_dedupe_similar_matches_sequential_scan(spark, group_links):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    rows = [(i, f"t{rng.randrange(4)}", " ".join(rng.sample(words, rng.randint(3, 8)))) for i in range(160)]
    rows += [(160 + i, t, m) for i, (_, t, m) in enumerate(rows[:20])] + [(190, "t1", ""), (191, "t1", None)]
    kept = []
    for i, t, m in rows:
        a = set((m or "").lower().split())
        if not any(kt == t and a and b and len(a & b) / max(len(a), len(b)) >= 0.8 for _, kt, b in kept):
            kept.append((i, t, a))
    out = joins.dedupe_similar(spark.createDataFrame(rows, "id long, t string, m string"), "id", "t", "m", group_links=group_links)
    assert [r[0] for r in values(out, "id")] == sorted(k[0] for k in kept)


def test_dedupe_similar_settles_a_long_chain_in_one_pass(spark):
    """Each row is like the next one only, so every second one stays; in rounds this would be one job for each link."""
    rows = [(i, "t", " ".join(f"w{j}" for j in range(i, i + 10))) for i in range(300)]
    out = joins.dedupe_similar(spark.createDataFrame(rows, "id long, t string, m string"), "id", "t", "m", 0.9)
    assert [r[0] for r in values(out, "id")] == list(range(0, 300, 2))


def test_phrase_join_against_brute_force(spark):
    rng = random.Random(11)
    letters = "abc dé漢😀.*("
    texts = {i: "".join(rng.choice(letters) for _ in range(rng.randrange(90))) for i in range(60)}
    wanted = {t[i:i + n] for t in texts.values() for n in (1, 2, 3, 4, 5, 9, 17, 40) for i in (rng.randrange(len(t) + 1),)} | {"ABC", "zzzz", "a b zz", "", "x"}
    rows = list(texts.items()) + [(100, "Alpha beta gamma"), (101, None), (102, ""), (103, "AB")]
    docs = spark.createDataFrame(rows, "id long, txt string").repartition(4)
    phrases = spark.createDataFrame([(p,) for p in [*wanted, "BETA", "a\ngamma", None, "ab"]], "p string")
    want = sorted((i, p) for i, t in rows for p in {w.lower() for w in [*wanted, "beta", "a\ngamma", "ab"]} if t and p and p in t.lower())
    assert values(matching.phrase_hits(docs, "id", "txt", phrases, "p"), "id", "phrase") == want
    assert values(matching.phrase_hits(docs, "id", "txt", phrases.limit(0), "p"), "id", "phrase") == []
    assert values(matching.phrase_hits(docs.limit(0), "id", "txt", phrases, "p"), "id", "phrase") == []


def test_phrase_join_with_many_phrases(spark):
    docs = spark.range(50).select("id", F.concat(L("order "), (C("id") * 6007).cast("string"), L(" was late; part no. "), C("id").cast("string")).alias("txt"))
    phrases = spark.range(300_000).select(F.concat(L("order "), C("id").cast("string")).alias("p"))
    got = values(matching.phrase_hits(docs, "id", "txt", phrases, "p"), "id", "phrase")
    numbers = {i: str(i * 6007) for i in range(50)}
    assert got == sorted((i, f"order {n[:k]}") for i, n in numbers.items() for k in range(1, len(n) + 1) if int(n[:k]) < 300_000)


def test_previous_values_cross_buckets(spark):
    df = spark.createDataFrame([(1, i, f"2024-01-0{1 + i // 3} 0{i % 3}:00:00") for i in range(8)], "k long, i long, s string").withColumn("ts", F.to_timestamp("s"))
    out = ordered.previous_values(df, ["k"], "ts", ["i"])
    assert [r[1] for r in values(out.withColumn("p", C("prev.i")), "i", "p")] == [None, *range(7)]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, q):
    import numpy as np
    data = [1.0, 2.0, 2.0, 2.0, 7.5, 9.0, 100.0, -3.0]
    got = ordered.exact_quantile(spark.createDataFrame([(v,) for v in data] + [(None,)], "v double"), "v", q, cells=5).first()[0]
    assert got == pytest.approx(float(np.quantile(data, q)))


def test_ranges_are_even_for_outliers_and_frequent_values(spark):
    """Equal-width cells put all but one value into one cell."""
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") == 0, 1e18).otherwise(F.col("id") / 1000).alias("v"))
    sizes = sorted(r["count"] for r in ordered.in_ranges(df, [F.col("v")], 16).groupBy("_cell").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    often = df.unionByName(df.limit(1).select(F.lit(3.5).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(9 * n)))).select("v"))
    assert ordered.exact_quantile(often, "v", 0.5, cells=16).first()[0] == 3.5
    assert ordered.exact_quantile(df, "v", 1.0, cells=16).first()[0] == 1e18


def test_pareto_of_a_long_tail_of_equal_counts(spark):
    rows = [("hot",)] * 50 + [("", ), (None,)] + [(f"k{i:05d}",) for i in range(3000)]
    got = windows.pareto(spark.createDataFrame(rows, "k string"), "k", cells=7).collect()
    want, cum = [], 0
    for label, n in sorted([("hot", 50), ("Non classé", 2)] + [(f"k{i:05d}", 1) for i in range(3000)], key=lambda x: (-x[1], x[0])):
        cum += n
        want.append((label, n, round(cum / 3052 * 100, 2)))
    assert [(r.label, r.n, pytest.approx(r.cumulative_pct, abs=0.011)) for r in sorted(got, key=lambda r: (-r.n, r.label))] == want


def test_exact_quantile_of_nothing(spark):
    assert ordered.exact_quantile(spark.createDataFrame([], "v double"), "v").first()[0] is None


def test_anonymize_numbers_by_first_appearance_and_restores(spark):
    body = "ND123456 puis ND999999 puis ND123456, 10.0.0.1 et j.dupont"
    df = spark.createDataFrame([(1, body), (2, "rien")], "id long, body string")
    rows, mapping = extract.anonymize(df, "id", "body")
    assert dict(rows.select("id", "body").collect())[1] == "[ND_01] puis [ND_02] puis [ND_01], [IP_01] et [AGENT_01]"
    assert values(mapping, "id", "token", "original") == [(1, "[AGENT_01]", "j.dupont"), (1, "[IP_01]", "10.0.0.1"), (1, "[ND_01]", "ND123456"), (1, "[ND_02]", "ND999999")]
    assert dict(extract.restore(rows, mapping, "id", "body").select("id", "body").collect()) == {1: body, 2: "rien"}


def test_clean_text_and_language(spark):
    df = spark.createDataFrame([("Bonjour, erruer seba. Merci d'avance",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.clean_ticket_text("t")).collect()] == ["erreur SEBA", ""]
    assert df.select(tx.detect_language(L("the check is on"))).first()[0] == "en"
    assert df.select(tx.detect_language(L("la le"))).first()[0] == "fr"


def test_ml_normaliser_keeps_the_order_of_steps(spark):
    got = spark.range(1).select(tx.normalize_for_ml(L("DSLAM OP49MAB11 bloqué erreur 1300 voir http://x.y [meta] 42"))).first()[0]
    assert got == "dslam equipment_id bloque error_code_1300 voir"


def test_canonical_codes_leave_years_out(spark):
    got = spark.range(1).select(tx.canonical_codes(L("AVP 1300 en 2024, B4002"))).first()[0]
    assert {(r.code, r.confidence) for r in got} == {("AVP1300", 0.99), ("B4002", 0.99), ("1300", 0.92)}


def test_log_level_order(spark):
    df = spark.createDataFrame([("warn then error",), ("WARNING x",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(tx.log_level("t")).collect()] == ["ERROR", "WARNING", "INFO"]


def test_performance_lines(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00 SYS_Op=2,30000",), ("2024-01-01 00:00:00 SYS_Op=60,60",), ("2024-01-01 00:00:00 SYS_Op=2,10",)], "line string")
    assert values(logs.parse_lines(df, "line", "performance"), "level", "error_code", "duration_ms") == [("ERROR", "SLOW_CALL", 15000), ("WARN", "HIGH_VOLUME", 1)]


def test_calibration_leaves_probability_one_out(spark):
    df = spark.createDataFrame([(1.0, True), (0.95, True), (0.05, False)], "p double, ok boolean")
    row = evaluation.ece(df, "p", C("ok")).first()
    assert row.n_binned == 2 and row.ece == pytest.approx((0.05 + 0.05) / 3, abs=1e-6)


def test_rare_class_takes_the_default_threshold(spark):
    df = spark.createDataFrame([("a", 0.9, True), ("a", 0.8, True)] + [("b", 0.6, True)] * 3 + [("b", 0.3, False)] * 3, "c string, p double, ok boolean")
    assert values(evaluation.class_thresholds(df, "c", "p", C("ok")), "c", "threshold") == [("a", 0.30), ("b", 0.35)]


def test_single_day_has_no_anomaly(spark):
    df = spark.createDataFrame([("2024-01-01",)] * 5, "d string").withColumn("ts", F.to_timestamp("d"))
    assert windows.volume_anomalies(df, "ts").count() == 0


def test_root_causes_keep_the_best_product(spark):
    e = spark.createDataFrame([("c", "m", 0.5), ("m", "s", 0.9), ("c", "s", 0.4), ("d", "c", 1.0)], "src string, dst string, weight double")
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "node string")
    got = values(graph.root_causes(e, one("s"), one("c", "d")), "cause", "confidence", "hops")
    assert got == [("c", 0.45, 2)]


def test_root_causes_against_all_simple_paths(spark):
    """Cycles, edges given twice, activated origins, equal products on longer ways, weights of 1 and null."""
    rng = random.Random(5)
    n = 14
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.5, 0.6, 0.8, 0.9, 1.0])) for _ in range(60)]
    hot, starts, best = {3, 5, 8, 11}, [0, 1, 3, 7], {}

    def walk(origin, node, p, path):
        for a, b, w in edges:
            if b == node and a not in path and len(path) <= 4:
                key = (origin, a)
                if a in hot:
                    best[key] = max(best.get(key, (0, 0)), (p * w, -len(path)))
                else:
                    walk(origin, a, p * w, path + [a])

    for s in starts:
        walk(s, s, 1.0, [s])
    e = spark.createDataFrame(edges + edges[:9] + [(4, 2, None)], "src long, dst long, weight double")
    one = lambda x: spark.createDataFrame([(v,) for v in x], "node long")
    got = graph.root_causes(e, one(starts + starts), one(hot), max_depth=3, k=99)
    want = sorted((o, c, round(min(p, 0.99), 6), -h) for (o, c), (p, h) in best.items())
    assert values(got, "symptom", "cause", "confidence", "hops") == want


def test_best_products_keep_a_row_for_each_node(spark):
    """A ladder has 2 ** 12 ways to its end; the walk holds one row a node."""
    rows = [(f"{i}{a}", f"{i + 1}{b}", 0.9 if a == b else 0.8) for i in range(12) for a in "xy" for b in "xy"]
    e = spark.createDataFrame(rows, "a string, b string, weight double")
    got = values(graph.best_products(e, spark.createDataFrame([("0x",)], "node string"), 12), "node", "prob", "hops")
    assert len(got) == 24 and all(h == int(node[:-1]) and p == pytest.approx(0.9 ** h if node[-1] == "x" else 0.9 ** (h - 1) * 0.8) for node, p, h in got)


def test_paths_do_not_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    p = graph.paths_from(e, spark.createDataFrame([(1,)], "id long"), "id", 5)
    assert sorted(r.path for r in p.collect()) == [[1], [1, 2], [1, 2, 3]]


@pytest.mark.parametrize("pivots,block_bytes,threshold", [(64, 1 << 20, None), (5, 300, None), (1, 1 << 20, None), (9, 2000, 0.7)])
def test_knn_against_brute_force(spark, pivots, block_bytes, threshold):
    """Clustered vectors, so that partitions are left out; ties, copies, zero vectors, and vectors of any length."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 4))
    vectors = [(centres[i % 6] + 0.15 * rng.standard_normal(4)) * rng.uniform(0.1, 9) for i in range(240)] + [[1.0, 0, 0, 0]] * 7 + [[0.0] * 4] * 4
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows + [(999, None)], "id long, v array<double>").repartition(6)
    m = np.array([v for _, v in rows])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sims = np.round(m @ m.T, 6)
    want = []
    for q in [i for i in range(len(rows)) if i % 9 == 0 or i > 235]:
        order = sorted(range(len(rows)), key=lambda j: (-sims[q, j], j))
        want += [(q, j, r + 1) for r, j in enumerate(order[:4]) if threshold is None or sims[q, j] >= threshold]
    got = retrieval.knn(df, df.filter("id % 9 = 0 or id > 235"), "id", "v", "id", 4, threshold, pivots=pivots, block_bytes=block_bytes)
    assert values(got, "query_id", "item_id", "rank") == sorted(want)
    assert retrieval.knn(df.limit(0), df, "id", "v", "id", 4).count() == retrieval.knn(df, df.limit(0), "id", "v", "id", 4).count() == 0


def test_suppression_starts_at_three_reports(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] * 3 + [("c",)] * 9, "h string")
    assert values(rollups.suppression(df, "h"), "h", "delta", "factor") == [("b", -0.1, 0.8), ("c", -0.5, 0.2097)]


def test_operators_on_empty_input(spark):
    empty = spark.createDataFrame([], "id long, k string, ts timestamp, v double")
    assert windows.pareto(empty, "k").count() == 0
    assert ordered.previous_values(empty, ["k"], "ts", ["v"]).count() == 0
    assert joins.missing_followups(empty, [("a", "b", 10)], "id", "k", "ts", "id").count() == 0
    assert rollups.top_values(empty, "k", 3).count() == 0


def test_unknown_check_is_refused():
    suite = rules.CheckSuite()
    with pytest.raises(KeyError):
        suite.plan("x", ["not_there"])


def test_combined_points_truncate_each_part(spark):
    assert spark.range(1).select(scores.combined_points(F.array(L(50), L(33), L(14)))).first()[0] == 58


# ---------------------------------------------------------------- sources and sinks
def test_ticket_reader(spark, scratch):
    path = f"{scratch}/t.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("\ufeffTicket;Résumé;Vide;Statut\n1; panne ;;0\n2;Inconnu;;clos\n")
    df = readers.read_tickets(spark, path)
    assert df.columns == ["Ticket", "Résumé", "Statut"]
    assert values(readers.canonicalize_columns(df).fillna("-"), "ticket", "inc_resume", "inc_statut") == [("1", "panne", "-"), ("2", "-", "clos")]


def test_log_reader_picks_parsers_by_file(spark, scratch):
    for name, line in {"nginx.log": '1.1.1.1 - - [15/Mar/2024:10:32:44 +0000] "GET /a HTTP/1.1" 500 1', "README.log": "ERROR no", "other.log": "2024-01-01 00:00:00 ERROR x"}.items():
        with open(f"{scratch}/{name}", "w") as f:
            f.write(line + "\n")
    assert values(readers.read_logs(spark, scratch), "strategy", "level", "service") == [("generic", "ERROR", "unknown"), ("http", "ERROR", "nginx")]


def test_corrections_skip_malformed_lines(spark, scratch):
    with open(f"{scratch}/c.jsonl", "w") as f:
        f.write('{"ticket_id":"1","corrected_label":"A"}\n{broken\n{"ticket_id":"2","corrected_label":"B"}\n')
    assert values(readers.read_corrections(spark, scratch), "ticket_id", "corrected_label") == [("1", "A"), ("2", "B")]


def test_upsert_keeps_the_latest_row(spark, scratch):
    mk = lambda rows: spark.createDataFrame(rows, "k string, ts string, v long").withColumn("ts", F.to_timestamp("ts"))
    store = f"{scratch}/store"
    sinks.upsert_keyed(mk([("a", "2024-01-01", 1), ("b", "2024-01-01", 2)]), store, "k", "ts", 4)
    sinks.upsert_keyed(mk([("a", "2024-01-02", 3), ("b", "2023-01-01", 9), ("c", "2024-01-01", 4)]), store, "k", "ts", 4)
    assert values(sinks.read_store(spark, store), "k", "v") == [("a", 3), ("b", 2), ("c", 4)]


def test_incremental_upsert_looks_back_24_hours(spark, scratch):
    df = spark.createDataFrame([("a", "2024-01-02 10:00:00"), ("b", "2023-12-30 10:00:00")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    sinks.incremental_upsert(df, f"{scratch}/s", "k", "ts", L("2024-01-02 12:00:00").cast("timestamp"))
    assert values(sinks.read_store(spark, f"{scratch}/s"), "k") == [("a",)]


def test_sessions_chunks_graph_and_csv(spark, scratch):
    df = spark.createDataFrame([(1, "x", ["p"]), (2, "y", ["q", "r"])], "id long, name string, tags array<string>")
    sinks.save_session(df, f"{scratch}/s", "one")
    sinks.save_session(df.limit(1), f"{scratch}/s", "two")
    sinks.save_session(df.filter("id = 2"), f"{scratch}/s", "two")
    assert values(sinks.load_session(spark, f"{scratch}/s", "two"), "id") == [(2,)]
    assert sinks.load_session(spark, f"{scratch}/s", "one").count() == 2
    for _ in range(2):
        sinks.write_chunks(df, f"{scratch}/c", C("name"), ["id"])
    assert spark.read.parquet(f"{scratch}/c").count() == 2
    e = spark.createDataFrame([("a", "b", "R")], "src string, dst string, rel_type string")
    sinks.write_graph(df, e, f"{scratch}/g")
    assert spark.read.parquet(f"{scratch}/g/edges").count() == 1
    sinks.export_csv(df, f"{scratch}/csv")
    assert values(spark.read.option("header", True).option("escape", "\\").csv(f"{scratch}/csv"), "id", "name") == [("1", "x"), ("2", "y")]


def test_file_scan(spark, scratch):
    with open(f"{scratch}/a.py", "w") as f:
        f.write("x = 1\ny = 2\n")
    rows = extract.artifact_rows(readers.scan_files(spark, scratch), "path", "content", {".py": "python"})
    assert values(rows, "language", "size_bytes", "n_lines") == [("python", 12, 3)]


def test_bm25_against_all_scores(spark):
    """Words in every document, words that stand once, queries of common words only, words that no document has."""
    import math
    import re
    rng = random.Random(9)
    words = ["all", "the", "most"] + [f"w{i:03d}" for i in range(120)]
    docs = [(i, " ".join(["all"] * rng.randint(1, 4) + (["the"] if i % 10 else []) + rng.choices(words, k=rng.randint(0, 30)))) for i in range(400)]
    docs += [(400, ""), (401, None), (402, "éventuel ventuelé all"), (403, docs[0][1])]
    queries = [(0, "all the"), (1, "all w001 w002 w003"), (2, "the the w050"), (3, "nothing here"), (4, " ".join(rng.choices(words, k=9))), (5, "ventuel all"), (6, None)]
    toks = lambda s: [w for w in re.findall(r"\w+", (s or "").lower()) if re.fullmatch("[a-z0-9_]{3,}", w)]
    held = {i: toks(s) for i, s in docs}
    df = {w: sum(w in set(x) for x in held.values()) for x in held.values() for w in x}
    avg, n = max(1.0, sum(map(len, held.values())) / (len(docs) - 1)), len(docs)  # a null text has no length
    want = []
    for k in (3, 40):
        rows = []
        for q, s in queries:
            scores = []
            for i, x in held.items():
                hits = [w for w in toks(s) if w in x]
                if hits:
                    scores.append((-round(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for w in hits), 6), i))
            rows += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(scores)[:k])]
        d, qs = spark.createDataFrame(docs, "id long, t string").repartition(4), spark.createDataFrame(queries, "q long, s string")
        assert values(retrieval.bm25(d, qs, "id", "t", "q", "s", k), "q", "id", "rank") == sorted(rows)


def test_common_words_bring_in_no_documents(spark):
    """A word of every document adds little: only documents of the rare word are scored, each with its whole score."""
    impacts = spark.createDataFrame([(i, "common", 1.0 + i / 1000) for i in range(1000)] + [(i, "rare", 1.0) for i in range(0, 1000, 100)], "id long, term string, w double")
    terms = spark.createDataFrame([(1, "common", 0.1, 0.2, 1000), (1, "rare", 5.0, 5.0, 10)], "q long, term string, qi double, ub double, df long")
    got = values(retrieval.scored_best(terms, impacts, "q", "id", 4, seeds=1), "id", "raw")
    assert [i for i, _ in got] == list(range(0, 1000, 100)) and all(raw == pytest.approx(5.1 + i / 10000) for i, raw in got)


def test_level_2_probabilities_stay_within_level_1(spark):
    rows = [(i, f"{'vlan port' if i % 2 else 'login page'} {'red' if i % 4 < 2 else 'blue'} item", "net" if i % 2 else "app", "r" if i % 4 < 2 else "b") for i in range(80)]
    rows += [(90, "red", "lone", "x"), (91, "red", None, "r"), (92, "blue", "app", None)]
    df = spark.createDataFrame(rows, "id long, t string, a string, b string")
    model = retrieval.train_l2(df, "t", "a", "b", "id")
    got = retrieval.predict_l2(model, df, "id", "a").collect()
    sums = {}
    for r in got:
        sums[r.id] = sums.get(r.id, 0) + r.probability
    assert set(sums) == set(range(80)) | {92} and all(abs(x - 1) < 1e-9 for x in sums.values())
    want = {i: b for i, _, _, b in rows[:80]}
    assert all((r.probability > 0.5) == (r.label == want[r.id]) for r in got if r.id < 80)


def test_upsert_touches_its_buckets_alone_and_replays_change_nothing(spark, scratch):
    import os
    mk = lambda rows: spark.createDataFrame(rows, "k string, ts string, v long").withColumn("ts", F.to_timestamp("ts"))
    store = f"{scratch}/store"
    sinks.upsert_keyed(mk([(f"k{i}", "2024-01-01", i) for i in range(40)]), store, "k", "ts", 8, batch_id=1)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(store) for f in fs if f.endswith(".parquet")}
    before, second = files(), mk([("k3", "2024-01-01", 300)])
    sinks.upsert_keyed(second, store, "k", "ts", 8, batch_id=2)
    after = files()
    assert len({os.path.dirname(f) for f in before ^ after}) == 1 and before & after
    want = [(f"k{i}", 300 if i == 3 else i) for i in range(40)]
    assert values(sinks.read_store(spark, store), "k", "v") == sorted(want)
    sinks.upsert_keyed(mk([("k3", "2024-01-01", 3)]), store, "k", "ts", 8, batch_id=1)  # an older batch once more
    sinks.upsert_keyed(second, store, "k", "ts", 8, batch_id=2)
    sinks.upsert_keyed(second.limit(0), store, "k", "ts", 8, batch_id=3)
    assert values(sinks.read_store(spark, store), "k", "v") == sorted(want)
    plan = sinks.touched_buckets(spark, store, [2, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan and "IN (2,5)" in plan
