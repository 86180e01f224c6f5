"""Hand fixtures: small graphs, logs and statistics worked out on paper."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgraph.functions.columns import exact_mean, normalize_correct, normalize_id
from skillgraph.functions.ranking import global_row_number, prefix_sums, quantiles
from skillgraph.operators import audit, features, graph, metrics, profile, relations, runs, similarity, splits
from skillgraph.sources import tables

LOG = [("1", "a", "q1", "x", 1, 1), ("2", "a", "q2", "y", 2, 0), ("3", "b", "q1", "x", 1, 1), ("4", "b", "q1", "y", 3, 1), ("5", "c", "q3", "z", 5, 0), ("6", "c", "q2", "y", 4, 1), ("7", "d", "q4", "x", 2, 0), ("8", "d", "q5", "z", 9, 1)]
COLS = "interaction_id string, learner_id string, question_id string, skill_id string, timestamp long, correct int"


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, COLS)


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src string, dst string, weight double")


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_similarity_by_hand(log):
    # x: q1 q4, y: q1 q2, z: q3 q5
    assert rows(relations.e_sim(log, 0.1), "src", "dst", "support_count") == {("x", "y", 1)}
    assert relations.e_sim(log, 0.1).first()["weight"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        relations.e_sim(log, 0)


def test_cooccurrence_by_hand(log):
    pairs = {(r["src"], r["dst"]): (r["support_count"], r["pmi"]) for r in relations.co_pairs(log).collect()}
    assert pairs[("x", "y")][0] == 2 and pairs[("x", "y")][1] == pytest.approx(math.log(2 * 4 / 9))
    assert pairs[("x", "z")][0] == 1 and pairs[("y", "z")][0] == 1
    mirrored = relations.mirror_edges(relations.e_co(log, 1, -9.0))
    assert mirrored.count() == 6


def test_prerequisites_and_reduction(spark):
    log = spark.createDataFrame([(str(i), "a", "q", f"s{i}", i, 1) for i in range(8)], COLS)
    top = relations.e_pre_topk(log, 5)
    assert top.count() == 5 * 3 + 4 + 3 + 2 + 1
    chain = {(f"s{i}", f"s{i + 1}") for i in range(7)}
    assert rows(graph.transitive_reduction(top), "src", "dst") == chain == rows(relations.e_pre_chain(log), "src", "dst")
    assert relations.e_pre_raw(log).count() == 28


def test_cycles(spark):
    one = edges_of(spark, [("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.1), ("c", "d", 1)])
    assert rows(graph.cyclic_core(one), "src", "dst") == {("a", "b"), ("b", "c"), ("c", "a")}
    fixed = graph.break_cycles(one)
    assert rows(fixed, "src", "dst") == {("a", "b"), ("b", "c"), ("c", "d")} and graph.is_dag(fixed)
    two = edges_of(spark, [("a", "b", 1), ("b", "a", 2), ("x", "y", 3), ("y", "x", 1), ("b", "x", 1), ("p", "q", 1)])
    assert rows(graph.strongly_connected(two), "node", "component") == {("a", "a"), ("b", "a"), ("x", "x"), ("y", "x")}
    assert rows(graph.break_cycles(two), "src", "dst") == {("b", "a"), ("x", "y"), ("b", "x"), ("p", "q")}
    assert graph.cyclic_core(one.limit(0)).count() == 0


def least_edges_removed(edges):
    """Removes the least edge of each strongly connected component until there is no cycle."""
    edges = set(edges)
    while True:
        reach = {n: {n} for e in edges for n in e[1:]}
        for _ in reach:
            for _, a, b in edges:
                reach[a] |= reach[b]
        inner = [e for e in edges if e[1] in reach[e[2]]]
        if not inner:
            return {e[1:] for e in edges}
        groups = {frozenset(n for n in reach[e[1]] if e[1] in reach[n]) for e in inner}
        edges -= {min(e for e in inner if e[1] in g) for g in groups}


@pytest.mark.parametrize(("task_edges", "parts"), [(50_000, 8), (20, 4)])
def test_cycles_of_dense_graphs(spark, monkeypatch, task_edges, parts):
    """One rule at every size: cut by weights down to groups of a few edges, the same ones go."""
    rng = random.Random(3)
    some = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}"): rng.randrange(9) for _ in range(60)} | {(f"m{rng.randrange(6)}", f"m{rng.randrange(6)}"): 1 for _ in range(20)}
    df = edges_of(spark, [(a, b, w) for (a, b), w in some.items()])
    monkeypatch.setattr(graph, "TASK_EDGES", task_edges)
    monkeypatch.setattr(graph, "PARTS", parts)
    assert rows(graph.break_cycles(df), "src", "dst") == least_edges_removed((w, a, b) for (a, b), w in some.items())


@pytest.mark.parametrize("task_edges", [1_000_000, 40])
def test_cycles_in_many_components(spark, monkeypatch, task_edges):
    """Components of a few edges are told by tasks, larger ones by their heaviest edges first; none of these is cut."""
    rng = random.Random(5)
    some = {(f"{c}{rng.randrange(9)}", f"{c}{rng.randrange(9)}"): rng.randrange(4) for c in "abc" for _ in range(50)}
    some |= {("z", "z"): 1, ("y", "y"): 2, ("y", "x"): 1}
    df = edges_of(spark, [(a, b, w) for (a, b), w in some.items()])
    monkeypatch.setattr(graph, "_cut_to_the_end", None)
    monkeypatch.setattr(graph, "TASK_EDGES", task_edges)
    assert rows(graph.break_cycles(df), "src", "dst") == least_edges_removed((w, a, b) for (a, b), w in some.items())


def test_cycles_behind_heavy_paths(spark, monkeypatch):
    """The heaviest edges connect nothing strongly, so what they leave is cut by weight."""
    some = {(f"n{i}", f"n{i + 1}"): 9 for i in range(8)} | {(f"n{i + 1}", f"n{i}"): i for i in range(8)} | {("n8", "n0"): 1, ("n3", "n0"): 4}
    df = edges_of(spark, [(a, b, w) for (a, b), w in some.items()])
    cuts, cut = [], graph._cut_to_the_end
    monkeypatch.setattr(graph, "_cut_to_the_end", lambda *args: cuts.append(1) or cut(*args))
    monkeypatch.setattr(graph, "TASK_EDGES", 8)
    assert rows(graph.break_cycles(df), "src", "dst") == least_edges_removed((w, a, b) for (a, b), w in some.items()) and cuts


def test_closing_edges_of_random_graphs():
    """Edges by halves against one edge after the other, with connections among them."""
    rng = np.random.default_rng(4)
    for n, m in ((3, 9), (8, 40), (30, 90), (60, 70), (60, 400)):
        for _ in range(20):
            a, b, judge = rng.integers(0, n, m), rng.integers(0, n, m), rng.random(m) < 0.8
            reach, want = {v: {v} for v in range(n)}, []
            for x, y, j in zip(a.tolist(), b.tolist(), judge.tolist()):
                want.append(j and x in reach[y])
                for v in reach:
                    if x in reach[v]:
                        reach[v] = reach[v] | reach[y]
            assert graph._closing(a, b, judge.copy()).tolist() == want


def test_deep_graphs(spark):
    names = [f"n{i * 7919 % 5000:04d}" for i in range(5000)]  # a chain of 5,000 nodes in no order of names
    chain = edges_of(spark, [(a, b, 1) for a, b in zip(names, names[1:])])
    assert {r["layer"] for r in graph.layers(chain).collect()} == set(range(5000))
    ring = chain.unionByName(edges_of(spark, [(names[-1], names[1000], 0.5)]))
    assert graph.cyclic_core(ring).count() == 4000
    order = edges_of(spark, [(a, names[i + k], 1) for i, a in enumerate(names[:90]) for k in range(1, 6)])
    assert graph.is_dag(order)
    assert rows(graph.transitive_reduction(order), "src", "dst") == {(a, b) for a, b in zip(names[:90], names[1:91])} | {(names[89], names[89 + k]) for k in range(2, 6)}


def random_dag(rng, n, m):
    at = rng.sample(range(n), n)
    return {(f"v{a}", f"v{b}") if at[a] < at[b] else (f"v{b}", f"v{a}") for a, b in (rng.sample(range(n), 2) for _ in range(m))}


def test_layers_and_reduction_of_random_graphs(spark):
    rng = random.Random(8)
    for n, m in ((12, 30), (40, 90)):
        pairs = random_dag(rng, n, m)
        depth: dict = {}
        longest = lambda v: depth[v] if v in depth else depth.setdefault(v, max([longest(a) + 1 for a, b in pairs if b == v], default=0))
        df = edges_of(spark, [(a, b, 1) for a, b in pairs])
        assert rows(graph.layers(df), "node", "layer") == {(v, longest(v)) for e in pairs for v in e} and graph.is_dag(df)
        after = {v: {b for a, b in pairs if a == v} for e in pairs for v in e}
        for v in sorted(after, key=lambda v: -depth[v]):
            after[v] = after[v].union(*(after[w] for w in after[v]))
        want = {(a, b) for a, b in pairs if not any(b in after[w] for x, w in pairs if x == a)}
        assert rows(graph.transitive_reduction(df), "src", "dst") == want
        a, b = max(pairs, key=lambda e: depth[e[1]])
        back = next(x for x, y in sorted(pairs) if y == a) if any(y == a for _, y in pairs) else b
        loop = df.unionByName(edges_of(spark, [(a, back, 1)]))
        stuck = {r["node"] for r in graph.layers(loop).where("layer is null").collect()}
        assert stuck == {a, back} | after[a] | after[back] and not graph.is_dag(loop)
        with pytest.raises(ValueError):
            graph.transitive_reduction(loop)


def test_graphs_of_odd_edges(spark):
    odd = edges_of(spark, [(None, "a", 1), ("a", None, 1), ("a", "b", 1), ("a", "b", 1), ("c", "c", 2), ("b", "d", 1)])
    assert rows(graph.layers(odd), "node", "layer") == {("a", 0), ("b", 1), ("d", 2), ("c", None)}
    assert rows(graph.cyclic_core(odd), "src", "dst") == {("c", "c")} and not graph.is_dag(odd)
    assert graph.break_cycles(odd).count() == 5
    assert rows(graph.connected_components(odd), "node", "component") == {("a", "a"), ("b", "a"), ("d", "a"), ("c", "c")}
    none = odd.limit(0)
    assert graph.is_dag(none) and all(f(none).isEmpty() for f in (graph.layers, graph.cyclic_core, graph.break_cycles, graph.transitive_reduction, graph.connected_components, graph.strongly_connected))


def test_components_with_a_hub_and_a_long_path(spark):
    pairs = [("hub", f"h{i}") for i in range(400)] + [(f"p{i * 37 % 400:03d}", f"p{(i + 1) * 37 % 400:03d}") for i in range(399)] + [("x", "y")]
    got = rows(graph.connected_components(edges_of(spark, [(a, b, 1) for a, b in pairs])), "node", "component")
    assert got == {(f"h{i}", "h0") for i in range(400)} | {("hub", "h0"), ("x", "x"), ("y", "x")} | {(f"p{i:03d}", "p000") for i in range(400)}


def test_components_of_a_random_graph(spark):
    rng = random.Random(4)
    pairs = [(f"c{rng.randrange(60)}", f"p{rng.randrange(60)}") for _ in range(55)]
    label = {n: n for e in pairs for n in e}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert rows(graph.connected_components(edges_of(spark, [(a, b, 1.0) for a, b in pairs])), "node", "component") == set(label.items())


def test_components_and_stats(spark):
    e = edges_of(spark, [("a", "b", 1), ("b", "c", 1), ("x", "y", 3)])
    assert rows(graph.connected_components(e), "node", "component") == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    s = graph.graph_stats(e, directed=False).first()
    assert (s["nodes"], s["edges"], s["density"]) == (5, 3, pytest.approx(0.3))
    assert graph.graph_stats(e.limit(0)).first()["density"] == 0


def test_provenance_counts(spark):
    pairs = [("a", "b", 1), ("b", "a", 1), ("c", "d", 1), ("d", "c", 1), ("e", "f", 1), ("f", "e", 1), ("a", "c", 1), ("g", "g", 1), ("a", "b", 1)]
    e = edges_of(spark, pairs).withColumns({"relation_type": F.lit("co"), "support_count": F.lit(2)})
    r = graph.edge_provenance_audit(e).first()
    assert (r["raw_rows"], r["unique_directed"], r["unique_undirected"], r["mirrored_pairs"], r["self_loops"], r["duplicate_rows"]) == (9, 8, 4, 3, 1, 1)
    sym = audit.symmetry_audit(e.withColumn("source_split", F.lit("train"))).first()
    assert sym["missing_reverse"] == 1 and sym["status"] == "FLAG"


def test_availability_keeps_absent_relations(spark):
    e = edges_of(spark, [("a", "b", 1)]).withColumn("relation_type", F.lit("co"))
    n = spark.createDataFrame([(3,)], "n_skills long")
    got = {r["relation_type"]: (r["edges"], r["flag"]) for r in graph.relation_availability(e, n, [("co", False), ("sim", False)]).collect()}
    assert got == {"co": (1, "moderate"), "sim": (0, "absent")}


def test_splits_are_disjoint_and_sized(spark):
    df = spark.range(200).select(F.concat(F.lit("i"), "id").alias("interaction_id"), F.concat(F.lit("l"), F.col("id") % 100).alias("learner_id"))
    split = splits.learner_split(df)
    sizes = {r["split"]: r["n_rows"] for r in splits.split_report(split).collect()}
    assert sizes == {"train": 140, "valid": 30, "test": 30}
    assert {r["status"] for r in splits.split_overlap_audit(split).collect()} == {"PASS"}
    folds = splits.make_folds(df, 2)
    assert rows(folds.where("fold = 0"), "learner_id", "split") == rows(split, "learner_id", "split")


def test_leaks_are_found(spark, log):
    split = log.withColumn("split", F.when(F.col("learner_id") == "d", "test").otherwise("train")).withColumn("skill_id", F.when(F.col("interaction_id") == "8", "new").otherwise(F.col("skill_id")))
    clean = edges_of(spark, [("x", "y", 1)]).withColumn("source_split", F.lit("train"))
    leaky = clean.unionByName(edges_of(spark, [("x", "new", 1)]).withColumn("source_split", F.lit("train")))
    assert audit.audit_l1(clean, split).first()["status"] == "PASS" and audit.audit_l1(leaky, split).first()["violations"] == 1
    assert audit.audit_l4(leaky, split).first()["status"] == "FAIL"
    train = split.where("split = 'train'")
    assert audit.rho_co(clean, train, split).first()["rho_co"] == 0
    assert audit.rho_co(leaky, split, split).first()["rho_co"] == pytest.approx(0.5)
    cut = spark.createDataFrame([(4,)], "cutoff long")
    assert audit.audit_l3(train, cut).first()["violations"] == 1


def test_auc_ties_one_class_and_mirror(spark):
    data = [("r", 1, 0.9), ("r", 0, 0.9), ("r", 1, 0.4), ("r", 0, 0.1), ("one", 1, 0.3)]
    df = spark.createDataFrame(data, "run string, y_true int, y_pred double")
    got = {r["run"]: r["auc"] for r in metrics.auc(df, ["run"]).collect()}
    assert got == {"r": pytest.approx(0.625), "one": None}
    flipped = {r["run"]: r["auc"] for r in metrics.auc(df.withColumn("y_pred", 1 - F.col("y_pred")), ["run"]).collect()}
    assert got["r"] + flipped["r"] == pytest.approx(1)
    assert metrics.nll(df.where("run = 'one'"), ["run"]).first()["nll"] == pytest.approx(-math.log(0.3))


def test_statistics(spark):
    d = [0.4, -0.1, 0.25, 0.7, 0.3, 0.15, 0.6]
    df = spark.createDataFrame([("v", i, x) for i, x in enumerate(d)], "k string, seed int, delta double")
    ci = runs.bootstrap_ci(df, ["k"], ["seed"], 300).first()
    assert ci["ci_low"] <= sum(d) / 7 <= ci["ci_high"]
    # t = 1 at one degree of freedom
    two = spark.createDataFrame([("v", 0.0), ("v", 1.0)], "k string, delta double")
    assert runs.paired_t_test(two, ["k"]).first()["p_two"] == pytest.approx(0.5)
    flat = spark.createDataFrame([("v", 0.0), ("v", 0.0)], "k string, delta double")
    assert runs.paired_t_test(flat, ["k"]).first()["p_two"] == 1 and runs.cohens_d(flat, ["k"]).first()["cohens_d"] == 0
    w = runs.wilcoxon(df, ["k"]).first()
    assert (w["w_plus"], w["w_minus"], w["p"]) == (27, 1, pytest.approx(4 / 128))


def test_holm(spark):
    # sorted: 0.001 x 4, 0.0125 x 3, 0.02 x 2 and 1: the third is held up to the second
    p = [0.02, None, 0.001, 0.0125]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, i int, p double")
    got = {r["i"]: r["p_holm"] for r in runs.holm(df, ["family"], ["i"]).collect()}
    assert got == {2: pytest.approx(0.004), 3: pytest.approx(0.0375), 0: pytest.approx(0.04), 1: 1}


def test_select_epsilon_keeps_the_auc_to_beat(spark):
    cands = [("a", 0, 0.7, 0.5), ("b", 1, 0.7005, 0.4), ("c", 2, 0.7012, 0.6)]
    df = spark.createDataFrame([("k", *c) for c in cands], "k string, variant string, order int, valid_auc double, valid_nll double")
    got = runs.select_epsilon(df, ["k"]).first()
    # b wins by NLL but 0.7 stays the AUC to beat, so c is above by more than 0.001
    assert (got["variant"], got["selection_reason"]) == ("c", "auc")


def test_early_stopping(spark):
    aucs = [0.5, 0.6, 0.6, 0.6, 0.6, 0.9]
    df = spark.createDataFrame([("r", i, a) for i, a in enumerate(aucs)], "run_id string, epoch int, valid_auc double")
    got = runs.early_stop_epoch(df, ["run_id"], patience=3).first()
    assert (got["best_epoch"], got["stop_epoch"]) == (1, 4)


def test_ingestion_rules(spark):
    df = spark.createDataFrame([("10.0", "TRUE", "a~~b~~"), ("1.05", "0", " c ")], "id string, ok string, skill_id string")
    assert rows(df.select(normalize_id("id").alias("i"), normalize_correct("ok").alias("c")), "i", "c") == {("10", 1), ("1.05", 0)}
    assert sorted(r["skill_id"] for r in tables.explode_skills(df).collect()) == ["a", "b", "c"]
    lines = spark.createDataFrame([("[2026-05-28 23:41:00]   [kdd2010 fold 0 seed 7] Model dkt Variant full -> Val AUC: nan, Test AUC: 0.5",), ("[23:41] start",)], "value string")
    assert rows(tables.parse_run_log(lines), "dataset", "fold", "seed", "model", "variant", "valid_auc", "test_auc") == {("kdd2010", 0, 7, "dkt", "full", None, 0.5)}
    assert [r["i"] for r in spark.createDataFrame([(12345678.0,), (7.0,)], "x double").select(normalize_id("x").alias("i")).collect()] == ["12345678", "7"]
    assert rows(tables.encode_ids(df.select("id"), "id", "code"), "id", "code") == {("1.05", 0), ("10.0", 1)}
    grid = spark.createDataFrame([("m", 1), ("m", 2)], "model string, seed int")
    done = spark.createDataFrame([("m", 1, str(i)) for i in range(4)], "model string, seed int, variant string")
    assert rows(tables.pending_runs(grid, done), "model", "seed") == {("m", 2)}


def test_row_numbers_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = global_row_number(df, ["v"]).where("rn <> v + 1").count()
    assert got == 0


def test_sequences_and_features(spark, log):
    seq = {r["learner_id"]: (r["skills"], r["corrects"]) for r in features.learner_sequences(log).collect()}
    assert seq["b"] == (["x", "y"], [1, 1]) and seq["c"] == (["y", "z"], [1, 0])
    padded = features.pad_sequences(features.learner_sequences(log), 3).first()
    assert len(padded["skills"]) == 3 and padded["corrects"][-1] == -1
    assert features.next_step_examples(log).count() == 4
    prior = features.prior_features(log).collect()
    assert all(r["prior_attempts"] == 0 and r["success_rate"] == 0 for r in prior)


def test_logistic_predictor(spark):
    df = spark.createDataFrame([(str(i), "s", i % 2, float(i % 2), 1, 0.0, 1.0) for i in range(40)], "interaction_id string, skill_id string, correct int, success_rate double, prior_attempts int, degree double, skill_code double")
    got = features.lr_predict(df, df)
    assert metrics.auc(got.withColumn("k", F.lit(1)), ["k"]).first()["auc"] == 1
    one = features.lr_predict(df.where("correct = 1"), df).select("y_pred").distinct().collect()
    assert len(one) == 1 and one[0][0] == pytest.approx(1 - 1e-6)


def test_logistic_optimum(spark):
    rng = random.Random(3)
    data = [(float(rng.randrange(50)), rng.random(), rng.randrange(9), rng.random()) for _ in range(400)]
    df = spark.createDataFrame([(*x, int(rng.random() < 1 / (1 + math.exp(1 - 2 * x[1] - x[0] / 60)))) for x in data], "skill_code double, success_rate double, prior_attempts int, degree double, correct int")
    got = features.lr_moments(df).collect()
    assert {r["feature"] for r in got} == {*features.FEATURES, "intercept"}
    assert all(r["expected"] == pytest.approx(r["observed"], rel=1e-3) for r in got)
    assert features.lr_moments(df.where("correct = 1")).count() == 0


def test_one_learner_with_most_rows(spark, monkeypatch):
    rng = random.Random(9)
    data = [(f"i{i:04}", None if i % 97 == 0 else "a" if i % 2 else f"l{i % 31}", "q", rng.choice("xy"), rng.randrange(40), rng.randrange(2)) for i in range(1500)]
    df = spark.createDataFrame(data, COLS)
    columns = ["interaction_id", "learner_id", "skill_id", "prior_correct", "prior_attempts", "success_rate"]
    plain = rows(features.prior_features(df), *columns)
    monkeypatch.setattr(features, "LONG_HISTORY", 100)
    long = features.prior_features(df)
    assert rows(long, *columns) == plain and len(plain) == 1500 and long.columns[:6] == df.columns
    own = sorted((d[4], d[0], d[3], d[5]) for d in data if d[1] == "a")
    got = {r["learner_id"]: r for r in features.learner_sequences(df).collect()}
    assert got["a"]["skills"] == [d[2] for d in own[-200:]] and got["a"]["corrects"] == [d[3] for d in own[-200:]] and None not in got
    steps = {r["place"]: (r["skill_id"], r["next_skill"], r["next_interaction"]) for r in features.next_step_examples(df).where("learner_id = 'a'").collect()}
    assert steps == {i + 1: (x[2], y[2], y[1]) for i, (x, y) in enumerate(zip(own[-200:], own[-199:]))}
    plan = features.learner_sequences(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # rows are cut before the shuffle


def test_noise_is_reproducible(spark, log):
    a = rows(relations.inject_label_noise(log, 0.5, 3), "interaction_id", "correct")
    assert a == rows(relations.inject_label_noise(log.repartition(3), 0.5, 3), "interaction_id", "correct")
    assert relations.inject_label_noise(log, 0.0, 3).where("noisy").count() == 0


def test_strata(spark):
    log = spark.createDataFrame([(f"{s}-{i}", "a", "q", f"s{s}", i, 1) for s in range(10) for i in range((s + 1) * 20)], COLS)
    got = {r["skill_id"]: r["stratum"] for r in profile.strata_rank(log).collect()}
    assert got["s0"] == "very_sparse" and got["s2"] == "sparse" and got["s5"] == "medium" and got["s9"] == "frequent"
    assert profile.frequency_bins(log, cumulative=True).where("bin = 'le100'").count() == 5


def test_run_tree(spark, tmp_path):
    out = tmp_path / "d" / "0" / "7" / "m" / "full"
    out.mkdir(parents=True)
    (out / "metrics.csv").write_text("epoch,train_loss\n1,0.5\n")
    got = tables.read_run_tree(spark, str(tmp_path)).first()
    assert (got["run_id"], got["variant"], got["train_loss"]) == ("d_0_7_m_full", "full", 0.5)


def test_prefix_sums_and_quantiles_span_partitions(spark):
    rng = random.Random(5)
    data = [(rng.choice("aab"), rng.randrange(40), rng.randrange(5)) for _ in range(500)] + [(None, 1, 2), ("a", None, 1)]
    df = spark.createDataFrame(data, "k string, v long, c long")
    distinct = df.where("v is not null").groupBy("k", "v").agg(F.sum("c").alias("c"))
    got = {(r["k"], r["v"]): r["before_c"] for r in prefix_sums(distinct, ["k"], ["v"], ["c"]).collect()}
    assert got == {(k, v): sum(c for k2, v2, c in data if k2 == k and v2 is not None and v2 < v) for k, v in got} and len(got) == distinct.count()
    q = {r["k"]: (r["a"], r["b"]) for r in quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    want = {r["k"]: tuple(r["p"]) for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).alias("p")).collect()}
    assert q.keys() == want.keys() and all(q[k] == pytest.approx(want[k]) for k in q)


def test_pairs_of_a_large_learner_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(relations, "PAIR_BLOCK", 3)
    own = spark.createDataFrame([("x", f"s{i}") for i in range(11)] + [("y", "s1"), ("y", "s2")], "learner_id string, skill_id string")
    got = sorted((r["src"], r["dst"]) for r in relations.pairs_sharing(own, "learner_id").collect())
    names = sorted(f"s{i}" for i in range(11))
    assert got == sorted([(a, b) for i, a in enumerate(names) for b in names[i + 1 :]] + [("s1", "s2")])


def test_a_hub_sends_few_edges_of_each_task(spark):
    hub = spark.range(20_000).select(F.when(F.col("id") % 1000 == 0, "other").otherwise("hub").alias("src"), F.format_string("n%05d", "id").alias("dst"), (F.col("id") * 7919 % 20_000).cast("double").alias("weight")).repartition(4)
    top = relations.top_k_out(hub, 5)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(top) and "WindowGroupLimit" in plan(relations.topk_similarity_table(hub))
    assert sorted(r["weight"] for r in top.where("src = 'hub'").collect()) == [float(x) for x in range(19_995, 20_000)]
    assert {r["k"]: r["edges"] for r in relations.topk_similarity_table(hub).collect()} == {3: 6, 5: 10, 10: 20, 20: 40}


def test_many_phrases_in_one_pass(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abAB ") for _ in range(rng.randrange(1, 5)))
    texts = ["".join(word() for _ in range(60)) for _ in range(30)] + [None, "", "aaaaa", "ÀÉ straße ÀÉ"]
    phrases = [(p, "FAIL") for p in sorted({word() for _ in range(400)} | {"aa", "AA", "àé", "nowhere"})]
    got = {r["phrase"]: (r["occurrences"], r["documents"], r["status"]) for r in audit.phrase_scan(spark.createDataFrame([(t,) for t in texts], "text string"), phrases).collect()}
    counts = {p: [(t or "").lower().count(p.lower()) for t in texts] for p, _ in phrases}
    assert got == {p: (sum(c), sum(map(bool, c)), "FAIL" if sum(c) else "PASS") for p, c in counts.items()}
    assert audit.phrase_scan(spark.createDataFrame([], "text string"), [("x", "WARN")]).collect()[0]["status"] == "PASS"
    with pytest.raises(ValueError):
        audit.phrase_scan(spark.createDataFrame([], "text string"), [("", "WARN")])


def test_columns_are_named_by_the_kind_of_table(spark):
    one = lambda columns: spark.createDataFrame([tuple(range(len(columns)))], columns)
    scores = tables.resolve_columns(one(["pre", "target", "weight", "score"]), "prerequisite_scores")
    assert scores.first().asDict() == {"src": 0, "dst": 1, "weight": 2, "score": 3}
    co = tables.resolve_columns(one(["kc_i", "kc_j", "score", "PMI", "split"]), "co_occurrence")
    assert co.first().asDict() == {"src": 0, "dst": 1, "score": 2, "weight": 3, "support_split": 4}
    # target is no truth of a prediction; from and to are no ends of a co-occurrence
    assert tables.missing_columns(one(["target", "prob", "kc_id"]), "predictions") == ["y_true"]
    assert tables.missing_columns(one(["from", "to", "weight"]), "co_occurrence") == ["src", "dst", "support_split"]
    clash = tables.resolve_columns(one(["learner_id", "user_id", "qid"]), "interactions")
    assert clash.first().asDict() == {"learner_id_given": 0, "learner_id": 1, "question_id": 2}
    assert tables.resolve_columns(one(["a.b", "uid"]), "interactions").columns == ["a.b", "learner_id"]


def plain_digest(found):
    texts = ["".join("-" if x is None else f"{len(str(x))}:{x}" for x in row) for row in found]
    total = sum(int(hashlib.sha256(t.encode()).hexdigest(), 16) for t in texts) % 2**256
    return hashlib.sha256(f"{len(found)}|{total:064x}".encode()).hexdigest()


def test_content_digest(spark):
    rng = random.Random(5)
    data = [("k", rng.choice(["a", "é", None, "", "1:a", "🜂x"]), rng.choice([None, 1, 22])) for _ in range(3000)] + [("j", "a", 1)]
    df = spark.createDataFrame(data, "k string, a string, b int")
    got = {r["k"]: (r["n_rows"], r["sha256"]) for r in splits.content_digest(df.repartition(7), ["k"], ["a", "b"]).collect()}
    want = {k: [r[1:] for r in data if r[0] == k] for k in "kj"}
    assert got == {k: (len(v), plain_digest(v)) for k, v in want.items()}
    digest = lambda found: splits.content_digest(spark.createDataFrame(found, "a string, b string"), [], ["a", "b"]).first()["sha256"]
    # repeats, nulls and the border between columns count; order does not
    assert digest([("x", "y"), ("z", None)]) == digest([("z", None), ("x", "y")])
    assert len({digest(t) for t in ([("ab", "c")], [("a", "bc")], [("a", None)], [("a", "")], [(None, "a")], [("ab", "c")] * 2, [])}) == 7


def test_manifest_finds_what_changed(spark, log):
    named = log.withColumn("split", F.when(F.col("learner_id") == "d", "test").otherwise("train")).withColumn("fold", F.lit(0))
    edges = relations.e_co(log, 1, -9.0).withColumns({"relation_type": F.lit("co"), "fold": F.lit(0)})
    manifest = lambda e, r, names=("co", "sim"): splits.provenance_manifest(e, r, ["fold"], list(names), ["src", "dst", "support_count"])
    first = manifest(edges, named)
    got = {r["relation_type"]: r for r in first.collect()}
    assert (got["co"]["num_edges"], got["sim"]["num_edges"], got["co"]["train_interactions_count"]) == (3, 0, 6)
    assert got["sim"]["edges_sha256"] == got["co"]["valid_hash"] == plain_digest([])
    status = lambda other: {r["relation_type"]: r["status"] for r in splits.compare_manifests(first, other, ["fold"]).collect()}
    assert status(manifest(edges.repartition(5), named.repartition(3))) == {"co": "PASS", "sim": "PASS"}
    assert status(manifest(edges.where("src <> 'x'"), named)) == {"co": "CHANGED", "sim": "PASS"}
    flipped = named.withColumn("correct", F.when(F.col("interaction_id") == "1", 0).otherwise(F.col("correct")))
    assert status(manifest(edges, flipped)) == {"co": "STALE", "sim": "STALE"}
    assert status(manifest(edges, named, ("co", "pre"))) == {"co": "PASS", "sim": "MISSING", "pre": "NEW"}


def plain_similar(sets, theta):
    found = {}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and both / len(sets[a] | sets[b]) >= theta:
                found[a, b] = both
    return found


@pytest.mark.parametrize("theta", [0.3, 0.5, 0.7, 2 / 3, 1.0])
def test_similar_sets_match_brute_force(spark, monkeypatch, theta):
    rng = random.Random(theta)
    base = [rng.sample(range(60), rng.choice([1, 3, 10, 20])) for _ in range(12)]
    sets = {f"s{i}": {q if rng.random() > 0.15 else rng.randrange(60) for q in rng.choice(base)} | {99} for i in range(50)}
    data = [(s, f"q{q}") for s, found in sets.items() for q in found] * 2 + [(None, "q1"), ("s1", None), (None, None)]
    df = spark.createDataFrame(data, "skill_id string, question_id string")
    want = plain_similar(sets, theta)
    assert want
    for block in (2000, 7):  # question 99 is in every set, and more blocks deal it out
        monkeypatch.setattr(relations, "PAIR_BLOCK", block)
        got = {(r["src"], r["dst"]): r["support_count"] for r in similarity.similar_sets(df, theta).collect()}
        assert got == want
    assert {(r["src"], r["dst"]): r["support_count"] for r in relations.e_sim(df, theta).collect()} == want
    work = similarity.similarity_work(df, theta).first()
    assert work["pairs_at_theta"] == len(want) <= work["pairs_verified"] <= work["pairs_met"] <= 50 * 49 // 2
    assert similarity.similar_sets(df.limit(0), theta).count() == 0


def test_thresholds_on_the_border(spark):
    # 0.7 x 10 is a hair above 7 in doubles; these sets have exactly 7 of 10 in common
    data = [("a", f"{q}") for q in range(10)] + [("b", f"{q}") for q in range(7)]
    df = spark.createDataFrame(data, "skill_id string, question_id string")
    assert rows(similarity.similar_sets(df, 0.7), "src", "dst", "support_count") == {("a", "b", 7)}
    assert similarity.similar_sets(df, 0.71).count() == 0
    with pytest.raises(ValueError):
        similarity.similar_sets(df, 0)
def test_metrics_of_one_pass_equal_the_single_ones(spark):
    rng = random.Random(5)
    data = [(f"m{i % 3}", rng.choice([0, 1]), round(rng.random(), 1)) for i in range(300)] + [("m0", None, 0.4), ("m1", 1, None), ("m4", 1, 0.0), ("m5", None, None), (None, 0, 0.5), (None, 1, 0.6)]
    preds = spark.createDataFrame(data, "model string, y_true int, y_pred double")
    got = {r["model"]: r for r in metrics.metrics(preds, ["model"]).collect()}
    assert {m: r["n"] for m, r in got.items()} == {"m0": 101, "m1": 101, "m2": 100, "m4": 1, "m5": 1, None: 2}
    for name, single in (("acc", metrics.accuracy), ("nll", metrics.nll), ("rmse", metrics.rmse), ("auc", metrics.auc)):
        for r in single(preds, ["model"]).collect():
            assert got[r["model"]][name] == (None if r[name] is None else pytest.approx(r[name])), (name, r)
    assert metrics.metrics(preds.limit(0), ["model"]).count() == 0
    strata = spark.createDataFrame([("a", "low"), ("b", "high")], "skill_id string, stratum string")
    placed = preds.where("model in ('m0', 'm1', 'm4')").withColumn("skill_id", F.when(F.col("model") == "m0", "a").when(F.col("model") == "m1", "b").otherwise("unknown"))
    assert rows(metrics.stratified_metrics(placed, strata, ["model"]), "model", "stratum", "n") == {("m0", "low", 101), ("m0", "high", 0), ("m1", "low", 0), ("m1", "high", 101), ("m4", "low", 0), ("m4", "high", 0)}


def test_provenance_of_odd_rows(spark):
    data = [("co", "a", "b", 1.0, 1), ("co", "a", "b", 3.0, 4), ("co", "b", None, 2.0, 2), ("co", None, None, None, None), ("co", "c", "c", 5.0, 9), ("co", "c", "c", 5.0, 9), ("sim", "a", "b", 0.5, None)]
    e = spark.createDataFrame(data, "relation_type string, src string, dst string, weight double, support_count long")
    r = {x["relation_type"]: x for x in graph.edge_provenance_audit(e).collect()}
    co, sim = r["co"], r["sim"]
    assert (co["raw_rows"], co["unique_directed"], co["unique_undirected"], co["mirrored_pairs"], co["self_loops"]) == (6, 2, 1, 0, 2)
    assert (co["support_sum"], co["support_mean"], co["support_median"], co["weight_min"], co["weight_max"], co["weight_mean"]) == (25, 5.0, 4.0, 1.0, 5.0, pytest.approx(3.2))
    assert (sim["raw_rows"], sim["support_mean"], sim["support_median"], sim["interpretation"]) == (1, None, None, "one row per edge")
    assert graph.edge_provenance_audit(e.limit(0)).count() == 0


def test_orders_of_skills_use_no_window_over_all_rows(spark, log):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pairs = edges_of(spark, [(f"n{i}", f"n{i * 7 % 50}", i) for i in range(50)])
    for df in (relations.e_pre_topk(log, 2), relations.e_pre_chain(log), relations.e_pre_raw(log)):
        assert " Window [row_number" not in plan(df) and " Window [lead" not in plan(df)
    noisy = relations.inject_edge_noise(pairs, 0.5, 3)
    assert "row_number" not in plan(noisy) and noisy.count() == 50 and rows(noisy, "src") == rows(pairs, "src")
    assert relations.e_pre_chain(log.limit(0)).count() == profile.strata_rank(log.limit(0)).count() == 0


def test_configurations_share_a_ranking(spark):
    rng = random.Random(8)
    log = spark.createDataFrame([(str(i), f"u{rng.randrange(30)}", "q", f"s{rng.choice([0, 1, 2, rng.randrange(14)])}", i, 1) for i in range(500)], COLS)
    grid = [(1, 0.0, 0), (1, 0.0, 2), (1, 0.1, 2), (3, 0.1, 1), (4, 0.05, 0), (99, 0.0, 3)]
    got = {(r["k_min"], r["pmi_min"], r["top_k"]): r for r in relations.e_co_sensitivity(log, grid).collect()}
    assert set(got) == set(grid)
    positive = relations.co_pairs(log).where("pmi > 0").toPandas()
    for k_min, pmi_min, top_k in grid:
        held = positive[(positive["support_count"] >= k_min) & (positive["pmi"] >= pmi_min)].sort_values(["pmi", "src", "dst"], ascending=[False, True, True])
        lists = {}
        for src, dst in zip(held["src"], held["dst"]):
            for end in (src, dst):
                lists.setdefault(end, []).append((src, dst))
        kept = {p for found in lists.values() for p in (found[:top_k] if top_k else found)}
        weights = held.loc[[p in kept for p in zip(held["src"], held["dst"])], "pmi"]
        r = got[(k_min, pmi_min, top_k)]
        assert (r["support_rows"], r["edges"]) == (len(held), len(kept))
        assert r["pmi_median"] == (pytest.approx(weights.median()) if kept else None)
        assert r["pmi_p25"] == (pytest.approx(weights.quantile(0.25)) if kept else None)


def test_first_rows_of_a_report(spark):
    t = spark.createDataFrame([(f"k{i:02d}", float(i) / 3, i) for i in range(30)] + [("a", float("nan"), None)], "k string, x double, n int")
    got = runs.report_rows({"t": (t, ["k"]), "none": (t.limit(0), ["k"])}, 3)
    assert rows(got, "table_name", "row", "column_name", "value") == {
        ("t", 1, "k", "a"), ("t", 1, "x", "NaN"), ("t", 1, "n", None), ("t", 2, "k", "k00"), ("t", 2, "x", "0.000000"), ("t", 2, "n", "0"), ("t", 3, "k", "k01"), ("t", 3, "x", "0.333333"), ("t", 3, "n", "1")}


def test_shared_counts(spark, monkeypatch):
    """Counts of pairs by brute force, with a key of very many skills, null rows and several tasks."""
    from itertools import combinations

    monkeypatch.setattr(relations, "PAIR_BLOCK", 6)
    monkeypatch.setattr(relations, "TASK_PAIRS", 10)
    held = {f"l{i}": [f"s{(i * j) % 17}" for j in range(i % 6 + 1)] for i in range(40)} | {"hub": [f"s{j}" for j in range(17)]}
    rows = {(k, s) for k, skills in held.items() for s in skills} | {(None, "s1"), ("l1", None)}
    expected, sizes = {}, {}
    for k in held:
        for pair in combinations(sorted({s for key, s in rows if key == k and s}), 2):
            expected[pair] = expected.get(pair, 0) + 1
    for _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    found = relations.shared_counts(spark.createDataFrame(sorted(rows, key=str), "learner_id string, skill_id string"), "learner_id").collect()
    assert {(r["src"], r["dst"]): r["support_count"] for r in found} == expected
    assert len(found) == len(expected)
    assert all((r["n_src"], r["n_dst"]) == (sizes[r["src"]], sizes[r["dst"]]) for r in found)


def test_materialize_is_parquet(spark):
    """What is read again is compressed and of known size, not a checkpoint of rows as they are in memory."""
    from skillgraph._session import materialize

    df = materialize(spark.range(200_000).selectExpr("id % 10 as a", "'some text that repeats' as b"))
    assert df.count() == 200_000 and df.inputFiles()
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2_000_000


def test_raw_order_is_dealt_over_tasks(spark):
    train = spark.createDataFrame([(f"s{i}", i % 50) for i in range(200)], "skill_id string, timestamp long")
    raw = relations.e_pre_raw(train)
    assert raw.count() == sum((i % 50) < (j % 50) for i in range(200) for j in range(200))
    assert raw.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_reliability_means_are_exact(spark):
    """160 scores of three places whose mean is 0.7237375: a sum of doubles misses it, one way or the other by their order."""
    choose = random.Random(0)
    scores = [choose.randrange(700, 800) for _ in range(160)]
    i = 0
    while sum(scores) != 115798:
        step = 1 if sum(scores) < 115798 else -1
        scores[i % 160] += step if 700 <= scores[i % 160] + step < 800 else 0
        i += 1
    scores = [x / 1000 for x in scores]
    for order in (scores, sorted(scores), sorted(scores, reverse=True)):
        preds = spark.createDataFrame([("m", 1, x) for x in order], "model string, y_true int, y_pred double").coalesce(1)
        table = metrics.reliability_table(preds, ["model"], 1).first()
        assert (table["n"], table["confidence"]) == (160, 0.7237375)
    odd = spark.createDataFrame([("a", 1, None), ("b", 1, float("inf")), ("b", 1, 0.5)], "model string, y_true int, y_pred double")
    found = {r["model"]: r["confidence"] for r in odd.groupBy("model").agg(exact_mean("y_pred").alias("confidence")).collect()}
    assert found == {"a": None, "b": float("inf")}


def test_pairs_of_repeated_rows(spark):
    """Rows of a learner and skill may repeat: a pair counts a learner once, and n counts a learner once."""
    rows = spark.createDataFrame([("l1", "a"), ("l1", "b"), ("l1", "a"), ("l2", "b"), ("l2", "a"), ("l3", "a"), (None, "a")], "learner_id string, skill_id string")
    assert [tuple(r) for r in relations.shared_counts(rows, "learner_id").collect()] == [("a", "b", 2, 4, 2)]


def test_quantiles_of_many_groups(spark, monkeypatch):
    """Groups of few rows by percentiles in their tasks, larger ones over range partitions: the same numbers."""
    import pandas as pd

    from skillgraph.functions import ranking

    monkeypatch.setattr(ranking, "GROUP_ROWS", 20)
    choose = random.Random(5)
    values = {f"s{i}": [choose.randrange(50) for _ in range(i + 1)] for i in range(40)} | {None: [3, 4]}
    df = spark.createDataFrame([(k, x) for k, xs in values.items() for x in xs] + [("none", None)], "skill_id string, timestamp long")
    found = {r["skill_id"]: (r["t"], r["q"]) for r in ranking.quantiles_of_many(df, ["skill_id"], "timestamp", {"t": 0.5, "q": 0.25}).collect()}
    assert found == {k: (pd.Series(xs).median(), pytest.approx(pd.Series(xs).quantile(0.25))) for k, xs in values.items()}


def test_views_write_the_order_once(spark):
    from skillgraph.plans.fixtures import Views

    assert all("sf0.001" not in path for path in Views(spark, "/root/testdata/sf0.001").pre.inputFiles())


def test_both_ways_meet_in_a_task(spark):
    """An edge follows its reverse in one task, so pairs of ends are as many before a shuffle as edges; one-way edges stay so."""
    edges = spark.range(0, 1000, 1, 4).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst", "id as support_count", "1.0D as weight", "'train' as source_split")
    both = relations.both_ways(edges, F.col("support_count") % 5 != 0)
    assert both.columns == edges.columns and both.count() == 1800
    per_task = both.groupBy(F.spark_partition_id(), F.least("src", "dst"), F.greatest("src", "dst")).count()
    assert per_task.count() == 1000
    row = audit.symmetry_audit(both.unionByName(both.limit(10)).unionByName(edges.where("support_count = 1").withColumn("dst", F.col("src")))).first()
    assert (row["edges"], row["missing_reverse"], row["status"]) == (1811, 200, "FLAG")
    assert relations.both_ways(edges).count() == 2000 and audit.symmetry_audit(relations.both_ways(edges)).first()["status"] == "PASS"


def test_planted_splits_are_written_once(spark):
    """Audits read the planted split three times; it comes from a narrow table, not from the log anew."""
    from skillgraph.plans import checks
    from skillgraph.plans.fixtures import Views

    split, _ = checks._planted(Views(spark, "/root/testdata/sf0.001"))
    assert split.columns == ["learner_id", "split", "skill_id"] and all("sf0.001" not in path for path in split.inputFiles())


def test_pairs_are_counted_in_blocks(spark, monkeypatch):
    """Many skills that seldom meet twice, and a key with more skills than a block: pairs travel in blocks of many, not as a row each."""
    from itertools import combinations

    monkeypatch.setattr(relations, "PAIR_BLOCK", 30)
    monkeypatch.setattr(relations, "TASK_PAIRS", 500)
    choose = random.Random(3)
    held = {f"k{i}": choose.sample(range(90), choose.randrange(1, 20)) for i in range(60)} | {"hub": list(range(70))}
    expected = {}
    for skills in held.values():
        for a, b in combinations(sorted(f"s{s:02d}" for s in skills), 2):
            expected[a, b] = expected.get((a, b), 0) + 1
    rows = spark.createDataFrame([(k, f"s{s:02d}") for k, skills in held.items() for s in skills], "key string, skill_id string")
    for least in (1, 2):
        counts, names, _ = relations.pair_counts(rows, "key", least)
        name = {r["i"]: r["skill_id"] for r in names.collect()}
        found = [((name[r["pair"] >> 32], name[r["pair"] & (2**32 - 1)]), r["support_count"]) for r in counts.collect()]
        assert len(found) == len(set(found)) and dict(found) == {p: c for p, c in expected.items() if c >= least}
    assert "HashAggregate" not in counts._jdf.queryExecution().optimizedPlan().toString() and counts.rdd.getNumPartitions() > 4
    few = spark.createDataFrame([("k", "a"), (None, "b")], "key string, skill_id string")
    assert relations.pair_counts(few, "key")[0].count() == 0


def test_paths_of_a_dag_are_followed_in_tasks(spark, monkeypatch):
    """Edges without a longer path, by numbers in tasks; this needed a row per node and chain."""
    gen, some = random.Random(8), set()
    for a in range(150):
        some |= {(f"n{a:03d}", f"n{b:03d}") for b in gen.sample(range(a + 1, 151), min(5, 150 - a))}
    after, reach = {}, {}
    for a, b in some:
        after.setdefault(a, set()).add(b)
    for a in sorted({x for e in some for x in e}, reverse=True):  # edges ascend by name
        reach[a] = after.get(a, set()).union(*(reach[b] for b in after.get(a, ())))
    want = {(a, b) for a, b in some if not any(b in reach[c] for c in after[a])}
    assert len(want) < len(some)
    df = spark.createDataFrame([*sorted(some), (None, "n000")], "src string, dst string")
    monkeypatch.setattr(graph, "TARGETS", 64)
    got = graph.transitive_reduction(df)
    assert {tuple(r) for r in got.collect()} == want | {(None, "n000")}
    with pytest.raises(ValueError):
        graph.transitive_reduction(df.unionByName(spark.createDataFrame([("n150", "n000")], df.schema)))


def test_pairs_travel_as_gaps():
    """A block of pairs that hardly repeat takes four bytes a pair at most, and gives the pairs and counts back."""
    gen = np.random.default_rng(5)
    for size, n, parts in ((60_000, 400_000, 7), (60_000, 400_000, 6), (50, 30_000, 5), (2, 1, 1), (3, 0, 4)):
        a, b = (np.sort(gen.integers(0, size, (n, 2)), axis=1) + 1).T
        pairs = a.astype(np.int64) << 32 | b
        step = relations._step(size + 1, parts)
        batch = relations._blocks(pairs.copy(), parts, step)
        rows_of = list(zip(*(batch.column(c).to_pylist() for c in ("part", "n", "pairs", "counts"))))
        got = [(relations._unblocked(p, m, data, parts, step), relations._widened(c, m) if c else np.ones(m, dtype=np.int64)) for p, m, data, c in rows_of]
        want, times = np.unique(pairs, return_counts=True)
        found = np.concatenate([g[0] for g in got] + [np.empty(0, dtype=np.int64)])
        order = np.argsort(found)
        assert found[order].tolist() == want.tolist() and np.concatenate([g[1] for g in got] + [np.empty(0, dtype=np.int64)])[order].tolist() == times.tolist()
        assert sum(len(data) + len(c or b"") for _, _, data, c in rows_of) <= 4 * len(want) + 20 * parts or size < 100
        assert len(want) < 1000 or max(m for _, m, _, _ in rows_of) < 1.2 * len(want) / parts


def test_edges_are_read_once(spark, tmp_path):
    """What audits and the weight distribution still ask is answered from counts, so the edges need not be written."""
    path = str(tmp_path / "edges")
    rows = [("a", "b", 2.0, 1, False, "train"), ("a", "c", 2.0, 3, False, "train"), ("b", "c", 5.0, 4, None, "train"), ("b", "d", -1.0, None, False, None)]
    spark.createDataFrame(rows, "src string, dst string, weight double, support_count long, directed boolean, source_split string").write.parquet(path)
    edges = spark.read.parquet(path)
    for df in (cdf := relations.weight_cdf(edges), found := audit.e_co_audit(edges)):
        assert not any(path in f for f in df.inputFiles())
    assert [tuple(r) for r in cdf.orderBy("weight").collect()] == [(-1.0, 0.25), (2.0, 0.75), (5.0, 1.0)]
    row = found.first().asDict()
    assert (row["edges"], row["support_min"], row["support_q25"], row["support_median"], row["support_q75"], row["support_max"]) == (4, 1, 2.0, 3.0, 3.5, 4)
    assert row["support_mean"] == 8 / 3 and row["positive_weights"] == 3 and row["status"] == "PASS"
    empty = audit.e_co_audit(edges.where("src = 'z'")).first()
    assert (empty["edges"], empty["support_mean"], empty["positive_weights"], empty["status"]) == (0, None, 0, "PASS")
