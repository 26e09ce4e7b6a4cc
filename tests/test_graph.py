from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans import queries_graph

SYMBOL = "tenant_id string, gitlab_project_id string, branch string, repo_path_with_namespace string, symbol_name string, symbol_fqn string, symbol_kind string, language string, docstring string, signature string, definition_file_path string, definition_chunk_id string, definition_url string, symbol_id string"


def symbols(spark, fqns, language="python"):
    rows = [("t", "1", "main", "g/p", f.rsplit(".", 1)[-1], f, "class", language, "First line.\nmore" if i == 0 else None, "class X", f"src/{f}.py", f"c:{f}", f"u:{f}", f"s:{f}") for i, f in enumerate(fqns)]
    return spark.createDataFrame(rows, SYMBOL)


def edges(spark, pairs):
    rows = [("t", "1", "main", a, b, f"c:{a}", "CALLS", 0.55, f"e:{i}") for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "tenant_id string, gitlab_project_id string, branch string, source_symbol_fqn string, target_symbol_fqn string, source_chunk_id string, edge_type string, confidence double, edge_id string")


PAY = ["g.p.pay.Charge", "g.p.pay.Refund", "g.p.pay.Ledger"]
BILL = ["g.p.bill.Invoice", "g.p.bill.LineItem", "g.p.bill.Tax"]


def test_two_clusters(spark):
    s = symbols(spark, PAY + BILL)
    e = edges(spark, [(PAY[0], PAY[1]), (PAY[1], PAY[2]), (PAY[0], PAY[2]), (BILL[0], BILL[1]), (BILL[1], BILL[2]), (BILL[0], BILL[2])])
    got = graph.community_rows(s, e).collect()
    assert sorted(r.label for r in got) == ["g.p (Charge cluster)", "g.p (Invoice cluster)"]
    one = next(r for r in got if "Charge" in r.label)
    assert one["size"] == 3 and one.edge_count == 3 and one.dominant_language == "python" and one.representative_chunk_id == "c:" + PAY[0]
    assert one.summary.startswith(f"Code community '{one.label}' in g/p.\nKey symbols (3 shown):\n- class Charge (g.p.pay.Charge): First line.\n- class Ledger (g.p.pay.Ledger): class X")
    assert one.summary.endswith("Files: " + ", ".join(sorted(f"src/{f}.py" for f in PAY)))


def test_small_groups_are_left_out_and_bare_names_resolved(spark):
    assert graph.community_rows(symbols(spark, PAY[:2]), edges(spark, [(PAY[0], PAY[1])])).count() == 0
    bare = edges(spark, [(PAY[0], "Refund"), (PAY[1], "other.Ledger"), (PAY[0], "Ledger"), (PAY[0], "Nothing"), (PAY[0], PAY[0]), ("unknown", PAY[0])])
    assert graph.community_rows(symbols(spark, PAY), bare).count() == 1
    assert graph.adjacency(symbols(spark, PAY), bare).count() == 6
    twice = symbols(spark, [*PAY, "g.q.Refund"])
    assert graph.resolve_edges(twice, edges(spark, [(PAY[0], "Refund")])).count() == 0


def plain_propagation(nodes, near):
    labels = {n: n for n in nodes}
    for _ in range(20):
        before = dict(labels)
        for n in nodes:
            if near.get(n):
                c = Counter(labels[m] for m in near[n])
                labels[n] = sorted(c, key=lambda x: (-c[x], x))[0]
        if before == labels:
            break
    return labels


def test_propagation_visits_in_order(spark):
    names = [f"n{i:02d}" for i in range(30)]
    pairs = [(names[i], names[(i * 7 + 3) % 30]) for i in range(30)] + [(names[i], names[(i + 1) % 30]) for i in range(0, 30, 2)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    got = {r.node: r.label for r in graph.communities(symbols(spark, names), edges(spark, pairs)).collect()}
    assert got == plain_propagation(sorted(names), near)


def test_expansion(spark):
    chain = ["m.A", "m.B", "m.C", "m.D"]
    s, e = symbols(spark, chain), edges(spark, [("m.A", "m.B"), ("m.B", "C"), ("m.C", "m.D"), ("m.A", "m.A")])
    fused = spark.createDataFrame([("q", "c:m.A", 1, "m.A")], "query_id string, chunk_id string, rank int, symbol_fqn string")
    kinds = spark.createDataFrame([("q", "usage_lookup")], "query_id string, query_type string")
    one = graph.expand(fused, kinds, e, s, hops=1).orderBy("rank").collect()
    assert [r.chunk_id for r in one] == ["c:m.B"]
    two = graph.expand(fused, kinds, e, s, hops=2).orderBy("rank").collect()
    assert [r.chunk_id for r in two] == ["c:m.B", "c:m.C"]
    all_ = graph.expand(fused, kinds, e, s, hops=9).collect()
    assert len(all_) == 3
    few = graph.expand(fused, kinds, e, s, hops=9, limit=2).collect()
    assert len(few) == 1  # what was met before counts against the limit of a hop
    other = kinds.withColumn("query_type", F.lit("deployment_question"))
    assert graph.expand(fused, other, e, s).count() == 0


def plain_expansion(seed, named, near, hops, limit):
    """Ranked chunks of a seed. named: (symbol_id, fqn, chunk_id); near: (edge_id, source, target), all of one type and confidence."""
    short = lambda f: f.rsplit(".", 1)[-1]
    out, frontier = [], {seed[0]}
    for hop in range(hops):
        met = sorted([(e, b) for e, a, b in near if a in frontier] + [(e, a) for e, a, b in near if b in frontier])[: max(5 * limit, 25)]
        names, found, chunks = {}, {}, {}
        for n, (_, other) in enumerate(met):
            if other not in frontier:
                names.setdefault(other, n)
        for other, n in names.items():
            for sid, fqn, chunk in named:
                if fqn == other or short(fqn) == short(other):
                    found[sid, fqn, chunk] = min(n, found.get((sid, fqn, chunk), n))
        best = sorted(found, key=lambda x: (found[x], x[0]))[: max(2 * limit, 20)]
        for k, (_, fqn, chunk) in enumerate(best):
            chunks.setdefault(chunk, (k, fqn))
        placed = enumerate(sorted(chunks, key=lambda c: (chunks[c][0], c))[:limit], 1)
        new = [(c, chunks[c][1]) for place, c in placed if c != seed[1] and c not in {x for x, _ in out} and (hop == 0 or place + len(out) <= limit)]
        if not new:
            break
        out, frontier = out + new, {fqn for _, fqn in new}
    return [c for c, _ in out]


def test_every_supplier_expands_as_by_brute_force(spark, data):
    s, e = queries_graph.code_graph(spark, data)
    s, e = s.cache(), e.cache()
    named = [(r.symbol_id, r.symbol_fqn, r.definition_chunk_id) for r in s.collect()]
    near = [(r.edge_id, r.source_symbol_fqn, r.target_symbol_fqn) for r in e.collect()]
    fused, kinds = queries_graph._seeded(spark, data)
    seeds = {r.query_id: (r.symbol_fqn, r.chunk_id) for r in fused.collect()}
    assert {*seeds} == {r.s_suppkey for r in spark.read.parquet(f"{data}/supplier.parquet").collect()}
    for hops, limit, rows in ((1, 10, graph.expand(fused, kinds, e, s, hops=1)), (3, 30, queries_graph.k_hop(spark, data))):
        got = {q: [] for q in seeds}
        for r in rows.orderBy("rank").collect():
            got[r.query_id].append(r.chunk_id)
        assert got == {q: plain_expansion(x, named, near, hops, limit) for q, x in seeds.items()}


def test_scopes_are_labelled_one_after_another_as_rows_come():
    """a scope's rows were held whole, as pandas strings and lists of strings."""
    import pyarrow as pa

    near = {("a", x): y for x, y in {"n1": ["n2", "n3"], "n2": ["n1", "n3"], "n3": ["n1", "n2", "n4"], "n4": ["n3", "n5"], "n5": ["n4"], "n6": []}.items()} | {(None, "z"): ["zz"], (None, "zz"): ["z"]}
    rows = []
    for p in ("a", None):
        own = sorted(n for q, n in near if q == p)
        rows += [("t", p, "main", n, None) for n in own] + [("t", p, "main", n, m) for n in own for m in near[p, n]]
    table = pa.Table.from_pylist([dict(zip((*graph.SCOPE, "node", "neighbor"), r, strict=True)) for r in rows], pa.schema([(c, pa.string()) for c in (*graph.SCOPE, "node", "neighbor")]))
    want = {(p, n): x for p in ("a", None) for n, x in plain_propagation(sorted(n for q, n in near if q == p), {n: m for (q, n), m in near.items() if q == p}).items()}
    for size in (1, 3, 100):
        got = [r for b in graph._labelled(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert {(r["gitlab_project_id"], r["node"]): r["label"] for r in got} == want and len(got) == len(want)


def test_equal_edges_meet_after_they_are_dealt_out(spark, data):
    """tasks held nearly all lines they read, as strings, in a table that met few equal ones."""
    s, e = queries_graph.code_graph(spark, data)
    for df in (e, graph.adjacency(s, e)):
        assert "RepartitionByExpression" in df._jdf.queryExecution().analyzed().toString()


def test_full_queries_look_no_further(spark, monkeypatch):
    """edges of names that nobody asks for were dealt out, and the neighbours of full queries looked up."""
    s, e = symbols(spark, PAY + BILL), edges(spark, [(PAY[0], PAY[1]), (PAY[1], PAY[2]), (PAY[0], PAY[2]), (BILL[0], BILL[1])])
    fused = spark.createDataFrame([(1, "c:" + PAY[0], 1, PAY[0]), (2, "c:" + BILL[0], 1, BILL[0])], "query_id long, chunk_id string, rank int, symbol_fqn string")
    asked, plain = [], graph.neighbours
    monkeypatch.setattr(graph, "neighbours", lambda frontier, *a: asked.append({r.query_id for r in frontier.collect()}) or plain(frontier, *a))
    got = graph.expand(fused, spark.createDataFrame([(1, "usage_lookup"), (2, "usage_lookup")], "query_id long, query_type string"), e, s, hops=2, limit=2).collect()
    assert asked == [{1, 2}, {2}]
    assert {(r.query_id, r.chunk_id) for r in got} == {(1, "c:" + PAY[1]), (1, "c:" + PAY[2]), (2, "c:" + BILL[1])}
