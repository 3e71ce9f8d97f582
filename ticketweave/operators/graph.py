"""Graphs as two tables (nodes, edges): build, look up, walk a bounded number of hops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketweave.functions.text import first_match, matches_any
from ticketweave.lineage import cut, written
from ticketweave.operators.ordered import first_k

_C, _L = F.col, F.lit
_union = lambda frames: reduce(DataFrame.unionByName, frames)


def build_graph(tickets: DataFrame, clusters: DataFrame, procedures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and unique edges from tickets (ticket_id, application, incident_type, codes[], systems[], cluster_id),
    clusters (cluster_id, application, incident_type, codes[]) and procedures (procedure_id, application, incident_type, codes[]).
    """
    nid = lambda prefix, c: F.concat(_L(prefix + ":"), _C(c).cast("string"))
    have = lambda df, c: df.filter(_C(c).isNotNull() & (_C(c).cast("string") != ""))
    edge = lambda df, sp, s, dp, d, rel: have(have(df, s), d).select(nid(sp, s).alias("src"), nid(dp, d).alias("dst"), _L(rel).alias("rel_type"))
    boom = lambda df, key, arr: df.select(key, F.explode(arr).alias("x"))
    specs = [
        (tickets, "TKT", "ticket_id", "application", "APP", "AFFECTS"), (tickets, "TKT", "ticket_id", "incident_type", "TYPE", "IS_TYPE"),
        (tickets, "TKT", "ticket_id", "cluster_id", "CLU", "BELONGS_TO"), (clusters, "CLU", "cluster_id", "application", "APP", "CONCERNS"),
        (clusters, "CLU", "cluster_id", "incident_type", "TYPE", "HAS_TYPE"), (procedures, "PROC", "procedure_id", "application", "APP", "APPLIES_TO"),
        (procedures, "PROC", "procedure_id", "incident_type", "TYPE", "RESOLVES"),
    ]
    ends = [dp for _, _, _, _, dp, _ in specs]
    edges = [edge(df, sp, s, dp, d, rel) for df, sp, s, d, dp, rel in specs]
    for df, sp, s, arr, dp, rel in [(tickets, "TKT", "ticket_id", "codes", "ERR", "HAS_CODE"), (tickets, "TKT", "ticket_id", "systems", "SYS", "MENTIONS"),
                                    (procedures, "PROC", "procedure_id", "codes", "ERR", "HANDLES_CODE")]:
        ends.append(dp)
        edges.append(edge(boom(df, s, arr).withColumn("x", F.upper("x")), sp, s, dp, "x", rel))
    all_edges = _union(edges).distinct()
    # A node's type is known where its id is made, so whoever asks for one type reads the rows of that type alone.
    names = {"TKT": "Ticket", "CLU": "Cluster", "PROC": "Procedure", "APP": "Application", "TYPE": "IncidentType", "ERR": "ErrorCode", "SYS": "System"}
    node = lambda df, c, prefix: df.select(c.alias("id"), F.when(c.isNotNull(), names[prefix]).otherwise("Unknown").alias("node_type"))
    own = [node(df, nid(p, k), p) for df, p, k in ((tickets, "TKT", "ticket_id"), (clusters, "CLU", "cluster_id"), (procedures, "PROC", "procedure_id"))]
    # A source of an edge has a row of its own.
    return _union([*own, *[node(e, _C("dst"), p) for e, p in zip(edges, ends)]]).distinct(), all_edges


def schema_graph(foreign_keys: DataFrame, relations: DataFrame) -> DataFrame:
    """Structural and domain relations (source, type, target) merged into unique edges."""
    cols = ["source", "type", "target"]
    both = foreign_keys.select(*cols).unionByName(relations.select(*cols))
    return both.filter("source <> '' and target <> ''").distinct()


def graph_density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*")).scalar(), edges.agg(F.count("*").alias("edges"))
    return e.select(n.alias("nodes"), "edges", F.when(n > 1, F.round(_C("edges") / (n * (n - 1)), 4)).otherwise(0.0).alias("density"))


def neighbors(edges: DataFrame, ids: DataFrame, node: str, direction: str = "both", rel: str | None = None) -> DataFrame:
    """(id, neighbor, rel_type, direction) of the wanted nodes."""
    e = edges if rel is None else edges.filter(_C("rel_type") == rel)
    wanted = ids.select(_C(node).alias("id")).distinct()
    out = lambda: e.join(wanted, e["src"] == wanted["id"]).select("id", _C("dst").alias("neighbor"), "rel_type", _L("out").alias("direction"))
    inc = lambda: e.join(wanted, e["dst"] == wanted["id"]).select("id", _C("src").alias("neighbor"), "rel_type", _L("in").alias("direction"))
    return {"out": out, "in": inc, "both": lambda: out().unionByName(inc())}[direction]()


def relations_by_type(nodes: DataFrame, edges: DataFrame, source_type: str, target_type: str) -> DataFrame:
    """Edges between nodes of two types. Edges outside the ids of either type are left out where they are read."""
    ends = lambda kind, name: written(nodes.filter(_C("node_type") == kind).select(_C("id").alias(name)), "ends")
    src, dst = ends(source_type, "src"), ends(target_type, "dst")
    for rows, end in ((src, "src"), (dst, "dst")):
        lo, hi = rows.agg(F.min(end), F.max(end)).first()
        edges = edges.filter(_C(end).between(_L(lo), _L(hi)))
    return edges.join(src, "src").join(dst, "dst").select("src", "rel_type", "dst")


def k_hop(edges: DataFrame, seeds: DataFrame, seed: str, k: int, directed: bool = False) -> DataFrame:
    """(start, node, distance) for nodes within ``k`` hops of each seed; each hop is one join, lineage is cut per hop.

    A hop first keeps the edges at its front, so that no task holds the distinct edges of the whole graph.
    """
    e = edges.select("src", "dst")
    e = e if directed else e.unionByName(e.select(_C("dst").alias("src"), _C("src").alias("dst")))
    front = written(seeds.select(_C(seed).alias("start"), _C(seed).alias("node")).distinct().withColumn("distance", _L(0)), "front")
    seen = front
    for hop in range(1, k + 1):
        near = e.join(front.select(_C("node").alias("src")).distinct(), "src", "left_semi").distinct()
        step = front.join(near, front["node"] == near["src"]).select("start", _C("dst").alias("node")).distinct()
        front = written(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", _L(hop)), "front")
        seen = seen.unionByName(front)
        if hop < k and front.isEmpty():
            break
    return seen.filter("distance > 0")


def paths_from(edges: DataFrame, seeds: DataFrame, seed: str, depth: int) -> DataFrame:
    """All simple directed paths of 0..depth edges from the seeds; the path itself guards against cycles."""
    e = edges.select("src", "dst").distinct()
    front = seeds.select(_C(seed).alias("start"), _C(seed).alias("node"), F.array(_C(seed)).alias("path"), _L(0).alias("depth"))
    layers = [front]
    for d in range(1, depth + 1):
        step = front.join(e, front["node"] == e["src"]).filter(~F.array_contains("path", _C("dst")))
        front = cut(step.select("start", _C("dst").alias("node"), F.array_append("path", _C("dst")).alias("path"), _L(d).alias("depth")))
        layers.append(front)
    return _union(layers)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by node type and relation type, and totals, as (metric, value, n)."""
    by = lambda df, col, name: written(df.groupBy(_C(col).alias("value")).agg(F.count("*").alias("n")).select(_L(name).alias("metric"), "value", "n"), name)
    total = lambda counts, name: counts.agg(F.coalesce(F.sum("n"), _L(0).cast("long")).alias("n")).select(_L("total").alias("metric"), _L(name).alias("value"), "n")
    of_nodes, of_edges = by(nodes, "node_type", "node_type"), by(edges, "rel_type", "rel_type")  # few rows: each side is read once
    return _union([of_nodes, of_edges, total(of_nodes, "nodes"), total(of_edges, "edges")])


def best_products(edges: DataFrame, origins: DataFrame, hops: int, stop: DataFrame | None = None) -> DataFrame:
    """(origin, node, prob, hops): the best product of weights over walks of at most ``hops`` edges a -> b from each origin.

    Weights lie between 0 and 1 (others count as the nearer of the two, null ones as no edge), so a detour never gains: one row
    per origin and node is kept, and only rows that the last hop made or improved are walked on from. Of equal products the one
    with fewer hops counts. ``stop`` nodes are reached and not passed, but a walk may begin at one.
    """
    e = edges.filter("weight is not null").groupBy("a", "b").agg(F.max(F.least(F.greatest("weight", _L(0.0)), _L(1.0))).alias("weight"))
    best = cut(origins.select(_C("node").alias("origin"), "node").distinct().select("*", _L(1.0).alias("prob"), _L(0).alias("hops")))
    for hop in range(1, hops + 1):
        front = best.filter(_C("hops") == hop - 1)
        if stop is not None and hop > 1:
            front = front.join(stop.select("node"), "node", "left_anti")
        step = front.join(e, front["node"] == e["a"]).select("origin", _C("b").alias("node"), (_C("prob") * _C("weight")).alias("prob"), _L(hop).alias("hops"))
        better = best.unionByName(step).groupBy("origin", "node").agg(F.max(F.struct("prob", (-_C("hops")).alias("less"))).alias("x"))
        best = cut(better.select("origin", "node", _C("x.prob").alias("prob"), (-_C("x.less")).alias("hops")))
        if hop < hops and best.filter(_C("hops") == hop).isEmpty():
            break
    return best.filter("hops > 0")


def root_causes(edges: DataFrame, symptoms: DataFrame, activated: DataFrame, max_depth: int = 4, k: int = 5) -> DataFrame:
    """Activated causes behind each symptom: walk edges backwards, stop at activated nodes, best product per cause.

    ``max_depth`` expansions reach up to max_depth + 1 hops.
    """
    back = edges.select(_C("dst").alias("a"), _C("src").alias("b"), "weight")
    hot = activated.select("node").distinct()
    best = best_products(back, symptoms, max_depth + 1, hot).join(hot, "node", "left_semi")
    scored = best.select(_C("origin").alias("symptom"), _C("node").alias("cause"), F.round(F.least("prob", _L(0.99)), 6).alias("confidence"), "hops")
    return first_k(scored, ["symptom"], [F.desc("confidence"), F.asc("cause")], k).withColumnRenamed("rn", "rank")


def activate_nodes(evidence: DataFrame, entity: str, kind: str, value: str, mapping: Sequence[tuple[str, str, str]], signals: Sequence[tuple[Sequence[str], str]] = (), text_kind: str = "log") -> DataFrame:
    """(entity, node) raised by evidence: exact (kind, value) mappings, and words inside log text."""
    exact = first_match([((_C(kind) == k) & (_C(value) == v), _L(n)) for k, v, n in mapping], _L(None).cast("string"))
    low = F.lower(value)
    words = [F.when((_C(kind) == text_kind) & matches_any(low, w), _L(n)) for w, n in signals]
    nodes = F.filter(F.array(exact, *words), lambda x: x.isNotNull())
    return evidence.select(entity, F.explode(nodes).alias("node")).distinct()


def causal_chain(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 5, follow: Sequence[str] = ("CAUSES", "TRIGGERS", "REQUIRES", "BLOCKS", "DEPENDS_ON")) -> DataFrame:
    """Per seed the deepest cause, reached nodes, actions by depth and confidence of the forward walk.

    nodes: id, node_type, visit_count; edges: src, dst, rel_type, weight. A node counts once at its smallest
    depth with the heaviest edge into it at that depth, also where it has no row among the nodes.
    """
    e = edges.filter(_C("rel_type").isin(list(follow))).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    front = seeds.select(_C("id").alias("seed"), _C("id").alias("node"), _L(0).alias("depth"), _L(None).cast("double").alias("weight")).distinct()
    seen = front
    for d in range(1, max_depth + 1):
        step = front.select("seed", "node").join(e, front["node"] == e["src"]).groupBy("seed", _C("dst").alias("node")).agg(F.max("weight").alias("weight"))
        front = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", _L(d).alias("depth"), "weight"))
        seen = seen.unionByName(front)
        if d < max_depth and front.isEmpty():
            break
    rows = seen.join(nodes.select(_C("id").alias("node"), "node_type", "visit_count"), "node", "left")
    action = F.when(_C("node_type") == "action", F.struct("depth", "node"))
    agg = rows.groupBy("seed").agg(
        F.max(F.when(_C("node_type") == "cause", F.struct("depth", F.struct("node").alias("n")))).alias("c"), F.count("*").alias("n_nodes"),
        F.slice(F.transform(F.array_sort(F.collect_set(action)), lambda x: x["node"]), 1, 6).alias("actions"),
        F.avg(F.log(F.greatest(_C("weight"), _L(0.01)))).alias("lw"), F.coalesce(F.sum("visit_count"), _L(0)).alias("visits"))
    base = F.when(_C("lw").isNull(), 0.7).otherwise(F.least(_L(1.0), F.exp("lw")))
    return agg.select("seed", _C("c.n.node").alias("deepest_cause"), "n_nodes", "actions", F.round(F.least(_L(1.0), base + F.log(1 + _C("visits")) * 0.15), 6).alias("confidence"))


def adjust_weights(edges: DataFrame, chain: DataFrame, delta: float) -> DataFrame:
    """Reinforce (delta > 0, cap 1) or suppress (delta < 0, floor .05) the edges (src, dst) of a chain by a tenth of delta."""
    hit = edges.join(chain.select("src", "dst", _L(True).alias("_h")).distinct(), ["src", "dst"], "left")
    moved = F.greatest(_L(0.05), F.least(_L(1.0), _C("weight") + delta * 0.1)) if delta < 0 else F.least(_L(1.0), _C("weight") + delta * 0.1)
    return hit.withColumn("new_weight", F.round(F.when(_C("_h"), moved).otherwise(_C("weight")), 6)).drop("_h")


def code_lookup(nodes: DataFrame, wanted: DataFrame, key: str, members: str, term: str) -> DataFrame:
    """(term, node) for wanted terms found in an array column, by an exploded index and an equi-join."""
    index = nodes.select(key, F.explode(members).alias("_m")).select(key, F.lower("_m").alias("_m")).distinct()
    terms = wanted.select(_C(term), F.lower(term).alias("_m")).distinct()
    return index.join(terms, "_m").select(term, key)


def subgraph(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """First ``limit`` nodes by id and the edges that leave them."""
    kept = nodes.orderBy("id").limit(limit)
    return kept, edges.join(kept.select(_C("id").alias("src")), "src", "left_semi")
