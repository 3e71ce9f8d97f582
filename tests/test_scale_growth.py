"""Operators whose input grew with the square of a table, or that read more than they ask for."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketweave.functions import text as tx
from ticketweave.operators import graph, retrieval, rollups
from ticketweave.tables import Tables

SIGNATURE = "k long, causes array<struct<cause:string,probability:double>>, known string, conf double"


def test_few_signatures_tell_the_causes_of_all(spark):
    rows = [(1, [(f"c{i}", i % 10 / 10)], None, None) for i in range(60)] + [(1, None, "sheet", 0.05 * i) for i in range(20)]
    rows += [(2, [], "sheet", None)] * 30 + [(3, None, None, None)] * 30 + [(4, [("a", None), ("b", 0.1)], "x", 0.9), (4, None, None, None)]
    sig = spark.createDataFrame(rows, SIGNATURE)
    ev = spark.createDataFrame([(i, i % 5, [None, "E"][i % 2], [None, "m"][i // 2 % 2]) for i in range(40)], "event long, k long, kind string, module string")
    few = rollups.telling_signatures(sig, "k", "causes", "known", "conf")
    assert all(r["count"] <= 11 for r in few.groupBy("k").count().collect())
    ask = lambda s: sorted(map(str, rollups.probable_causes(ev.join(s, "k"), "event", "causes", "known", "conf", "kind", "module").collect()))
    assert ask(few) == ask(sig) and len(ask(sig)) > 40


def test_rows_of_one_row_group_are_dealt_to_all_tasks(spark, scratch):
    """Many splits of a file with one row group leave all rows in one of them."""
    spark.range(400_000).select(F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("h")).coalesce(1).write.parquet(f"{scratch}/events.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        t = Tables(spark, scratch)
        sizes = [r[0] for r in t.spread(t.events).groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 400_000 and len(sizes) >= 8 and max(sizes) < 100_000


def test_exception_class_with_and_without_its_package(spark):
    rows = [("x com.a.EXCEPTION.b.MyError: y",), ("a.b.c.d exceptionFoo",), ("SocketTimeoutException",), (None,), (".exception.XException",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.exception_class("t", {"SocketTimeoutException": "S"})).collect()]
    assert got == ["MyError", None, "SocketTimeoutException", None, None]


def test_graph_types_relations_and_totals(spark):
    tk = spark.createDataFrame([(1, "A", "t", ["e1"], ["s"], 7), (1, "A", "t", ["e1"], ["s"], 7), (2, "", None, [], [], None), (None, "B", "t", ["e2"], [], 8)],
                               "ticket_id long, application string, incident_type string, codes array<string>, systems array<string>, cluster_id long")
    cl = spark.createDataFrame([(7, "A", "t")], "cluster_id long, application string, incident_type string")
    pr = spark.createDataFrame([(1, "A", "u", ["e1", "e9"]), (2, None, "u", None)], "procedure_id long, application string, incident_type string, codes array<string>")
    nodes, edges = graph.build_graph(tk, cl, pr)
    ids = {r.id: r.node_type for r in nodes.collect()}
    assert ids == {"TKT:1": "Ticket", "TKT:2": "Ticket", None: "Unknown", "CLU:7": "Cluster", "PROC:1": "Procedure", "PROC:2": "Procedure", "APP:A": "Application",
                   "TYPE:t": "IncidentType", "TYPE:u": "IncidentType", "ERR:E1": "ErrorCode", "ERR:E9": "ErrorCode", "SYS:S": "System"} and nodes.count() == 12
    assert {tuple(r) for r in graph.relations_by_type(nodes, edges, "Procedure", "ErrorCode").collect()} == {("PROC:1", "HANDLES_CODE", "ERR:E1"), ("PROC:1", "HANDLES_CODE", "ERR:E9")}
    assert graph.relations_by_type(nodes, edges, "Procedure", "none").count() == 0
    stats = {(r.metric, r.value): r.n for r in graph.graph_stats(nodes, edges).collect()}
    assert stats["total", "nodes"] == 12 and stats["total", "edges"] == edges.count() and stats["node_type", "Procedure"] == 2
    none = {(r.metric, r.value): r.n for r in graph.graph_stats(nodes.limit(0), edges.limit(0)).collect()}
    assert none == {("total", "nodes"): 0, ("total", "edges"): 0}


def test_hops_meet_repeated_edges_once(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 4), (5, 1)] * 3, "src long, dst long")
    seeds = spark.createDataFrame([(1,), (1,)], "id long")
    assert sorted(map(tuple, graph.k_hop(e, seeds, "id", 2).collect())) == [(1, 2, 1), (1, 3, 2), (1, 5, 1)]
    assert sorted(map(tuple, graph.k_hop(e, seeds, "id", 3, directed=True).collect())) == [(1, 2, 1), (1, 3, 2), (1, 4, 3)]


def test_texts_are_cut_into_words_once_for_all_stages(spark):
    """Fitting and weighing read the words that were written, not the texts again."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = [(i, "alpha beta" if i % 2 else "beta gamma delta", "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t string, y string").withColumn("t", seen("t"))
    out = retrieval.tfidf(df, "t", 10, 1)
    assert out.count() == 60 and read.value == 60 and {"k", "t", "y", "features"} <= set(out.columns)
    model, test = retrieval.train_classifier(df, "t", "y", "k")
    assert read.value <= 180
    best = retrieval.predict(model, test, "k").groupBy("k").agg(F.max_by("label", "probability").alias("y")).collect()
    assert best and all(r.y == "xy"[r.k % 2] for r in best)


def test_knn_holds_few_scores_at_a_time():
    """Two blocks within their bytes may make more scores than a task can hold."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    draw = np.random.default_rng(5).normal(size=(9_000, 4))
    a = pd.DataFrame({"id": np.arange(8_000)[::-1], "v": list(draw[:8_000])})
    c = pd.DataFrame({"_q": np.arange(1_000), "_v": list(draw[8_000:])})
    tracemalloc.start()
    got = retrieval._block_best("id", "v", 3, held=100_000)(a, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(a) * len(c) / 4
    assert got.equals(retrieval._block_best("id", "v", 3, held=1 << 30)(a, c)) and len(got) == 3_000
