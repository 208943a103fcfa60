"""Neighbours, oversampling, export names and the two training runs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vigilrow.functions.columns import FEATURES
from vigilrow.operators import boosting as B
from vigilrow.operators import elastic as EN
from vigilrow.operators import models as M
from vigilrow.operators import neighbours as NB
from vigilrow.operators import ngram as N
from vigilrow.operators import reports as R
from vigilrow.operators import trees as T
from vigilrow.operators.dataset import require_samples
from vigilrow.operators.oversample import borderline_points, borderline_smote
from vigilrow.plans import train as TR
from vigilrow.plans.catalog import table


def brute_nearest(points, k):
    out = {}
    for a, va in points.items():
        near = sorted((float(np.sqrt(((np.array(va) - np.array(vb)) ** 2).sum())), b) for b, vb in points.items() if b != a)
        out[a] = near[:k]
    return out


def test_neighbours_are_exact(spark, monkeypatch):
    monkeypatch.setattr(NB, "POINTS_PER_PIVOT", 20)
    monkeypatch.setattr(NB, "BLOCK_ROWS", 16)
    random.seed(1)
    # A crowded corner next to scattered points.
    points = {f"p{i}": [random.gauss(0, 0.01 if i % 3 else 5) for _ in range(6)] for i in range(300)}
    df = spark.createDataFrame(list(points.items()), "vid string, vec array<double>").cache()
    got = {}
    for r in NB.nearest(df, df, 7).collect():
        got.setdefault(r["vid"], []).append((r["place"], r["distance"], r["nid"]))
    for vid, near in brute_nearest(points, 7).items():
        assert [(n, pytest.approx(d)) for _, d, n in sorted(got[vid])] == [(b, d) for d, b in near], vid


def test_neighbour_search_is_shared_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(NB, "BLOCK_ROWS", 16)
    random.seed(3)
    # Whole numbers: many equal distances; an offset: large sums hide small distances.
    points = {f"p{i}": [1e6 + random.randrange(3), 1e6 + random.randrange(3), random.randrange(2)] for i in range(300)}
    points["p7"] = [float("inf"), 0.0, 0.0]
    df = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in points.items()], "vid string, vec array<double>").cache()
    finite = {n: v for n, v in points.items() if n != "p7"}
    spark.sparkContext.setJobGroup("neighbour-tasks", "")
    try:
        got = {}
        for r in NB.nearest(df, df, 7).collect():
            got.setdefault(r["vid"], []).append((r["place"], r["nid"], r["distance"]))
    finally:
        spark.sparkContext.setJobGroup("tests", "")
    assert set(got) == set(finite)
    for vid, near in brute_nearest(finite, 7).items():
        assert [(n, d) for _, n, d in sorted(got[vid])] == [(b, pytest.approx(d)) for d, b in near], vid
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for job in status.getJobIdsForGroup("neighbour-tasks") for s in status.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages if s) >= 8


def test_borderline_points(spark):
    random.seed(2)
    rows = [(i, [random.gauss(0, 1), random.gauss(0, 1)], int(i < 40), int(i >= 40)) for i in range(160)]
    # Copies: vector 3 is held by two small-class rows and one other row.
    rows[3] = (3, rows[3][1], 2, 1)
    df = spark.createDataFrame([(f"{i:03}", v, a, b) for i, v, a, b in rows], "vid string, vec array<double>, own long, other long").cache()
    near = brute_nearest({f"{i:03}": v for i, v, _, _ in rows}, 10)
    held = {f"{i:03}": (a, b) for i, _, a, b in rows}
    want = set()
    for vid, (own, other) in held.items():
        if own:
            line = [0] * (own - 1) + [1] * other
            for _, n in near[vid]:
                line += [0] * held[n][0] + [1] * held[n][1]
            if 5 <= sum(line[:10]) < 10:
                want.add(vid)
    assert {r["vid"] for r in borderline_points(df).collect()} == want and want


def test_oversampling_reaches_parity(spark):
    random.seed(4)
    rows = [(int(i % 4 == 0), random.gauss(i % 4 == 0, 1.0), random.gauss(0, 1.0)) for i in range(400)]
    # A third of all rows are copies of one row of the larger class.
    rows += [(0, 0.25, 0.25)] * 200
    df = spark.createDataFrame(rows, "label int, x double, y double")
    grown = borderline_smote(df, ("x", "y")).cache()
    assert {r["label"]: r["count"] for r in grown.groupBy("label").count().collect()} == {0: 500, 1: 500}
    small = [(x, y) for a, x, y in rows if a == 1]
    low, high = np.min(small, axis=0), np.max(small, axis=0)
    for r in grown.where("label = 1").collect():
        assert low[0] - 1e-9 <= r["x"] <= high[0] + 1e-9 and low[1] - 1e-9 <= r["y"] <= high[1] + 1e-9
    again = borderline_smote(df.repartition(3), ("x", "y"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, grown.collect()))


def test_export_names_are_free_and_complete(spark):
    random.seed(6)
    names = ["a.php", "a_1.php", "a_2.php", "a_1_1.php", "a_4.php", "b", "b_1", ".htaccess", ".htaccess_1", "c_01.php", "c.php"]
    rows = [("X" if i % 5 else "Y", f"/{i}/{random.choice(names)}") for i in range(400)]
    df = spark.createDataFrame(rows, "verdict string, file string")
    got = [tuple(r) for r in R.export_names(df).collect()]
    assert sorted((v, f) for v, f, _ in got) == sorted(rows)
    assert len({(v, n) for v, _, n in got}) == len(rows)
    for verdict in "XY":
        own = {f.rsplit("/", 1)[1] for v, f in rows if v == verdict}
        made = {n for v, _, n in got if v == verdict}
        assert own <= made
        # Numbers are taken without holes.
        for base in own:
            stem, dot, suffix = base.rpartition(".") if base.count(".") and not base.startswith(".") else (base, "", "")
            if base.startswith("."):
                stem, dot, suffix = base, "", ""
            copies = sum(f.endswith("/" + base) and v == verdict for v, f in rows)
            free, number = 0, 0
            while free < copies - 1:
                number += 1
                if f"{stem}_{number}{dot}{suffix}" not in own:
                    free += 1
                assert f"{stem}_{number}{dot}{suffix}" in made


def labelled(spark, n=320):
    random.seed(8)
    rows = []
    for i in range(n):
        bad = i % 2
        words = ["eval", "shell", "cmd"] if bad else ["page", "title", "menu"]
        text = " ".join(random.choice(words + ["the", "and", "or", "x"]) for _ in range(30))
        rows.append((i, text, bad))
    return spark.createDataFrame(rows, "file_id long, code string, label int")


def test_ngram_training_with_search(spark):
    run = TR.train_ngrams(labelled(spark), M.LinearSettings(rounds=20), M.Grid(c=(0.3, 1.0), l1_share=(0.1, 0.5)))
    row = run.metrics.first()
    assert row["test_auc"] > 0.95 and row["char_features"] > 100 and not row["overfit"]
    assert run.search.count() == 4 and {r["c"] for r in run.search.collect()} == {0.3, 1.0}
    top = R.top_terms(run.coefficients).where("side = 'bad'").orderBy(F.desc("coefficient")).first()["term"]
    assert top.startswith(("CHAR:", "WORD:")) and M.nonzero(run.coefficients).first()["nonzero"] > 0
    texts = labelled(spark).withColumn("clean", F.col("code"))
    cells = N.weights(texts, run.vocabulary)
    norms = cells.join(run.vocabulary, "term_id").groupBy("file_id", "block").agg(F.sum(F.col("value") ** 2).alias("n"))
    assert all(r["n"] == pytest.approx(1.0) for r in norms.collect())


def test_tree_training(spark, tmp_path):
    random.seed(9)
    rows = []
    for i in range(300):
        bad = int(i % 3 == 0)
        row = {f: 0.0 for f in FEATURES}
        row |= {"file_id": i, "label": bad, "entropy": random.gauss(5 + bad, 0.5), "exec_func_count": float(random.randint(0, 2) + bad)}
        rows.append(row)
    df = spark.createDataFrame(rows)
    run = TR.train_trees(df, M.TreeSettings(rounds=5, depth=3))
    row = run.metrics.first()
    assert row["validation_auc"] > 0.85 and row["val_samples"] == 60 and row["train_samples"] == 320
    assert R.top_importances(run.importances, 1).first()["feature"] in ("entropy", "exec_func_count")
    # The rows of nodes score as the model does, and the model can be kept as MLlib's too.
    scored = M.bad_probability(run.model, M.assemble(TR.tree_features(df, run.scaler, "train")), "mllib")
    scored = T.with_probability(scored, run.nodes, name="rows")
    assert scored.agg(F.max(F.abs(F.col("mllib") - F.col("rows")))).first()[0] < 1e-12
    from pyspark.ml.classification import GBTClassificationModel

    from vigilrow.sinks.writers import write_model

    write_model(run.model, str(tmp_path / "model"))
    assert GBTClassificationModel.load(str(tmp_path / "model")).getNumTrees == 5
    grown = TR.train_trees(df, B.LeafwiseSettings(rounds=4, step=0.3), oversample=False)
    assert grown.model is None and grown.metrics.first()["validation_auc"] > 0.85
    top = R.top_importances(grown.importances, 2).collect()
    assert {r["feature"] for r in top} == {"entropy", "exec_func_count"} and grown.importances.count() == len(FEATURES)


# --- many linear models in one pass ----------------------------------------------------


def linear_rows(spark, n=400, size=30):
    r = np.random.default_rng(2)
    true = r.normal(size=size) * (r.random(size) < 0.5) * 3
    rows = []
    for i in range(n):
        ids = np.sort(r.choice(size, 8, replace=False))
        v = r.random(8)
        v /= np.linalg.norm(v)
        y = int(r.random() < 1 / (1 + np.exp(-(v @ true[ids]))))
        rows.append((ids.tolist(), v.tolist(), y, 1.0 + 0.5 * y, i % 3))
    rows[0] = ([], [], rows[0][2], 1.0, 0)  # a text without known terms
    return rows, spark.createDataFrame(rows, "ids array<int>, values array<double>, label int, weight double, fold int").repartition(4).cache()


def test_models_of_a_grid_reach_their_optimum(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rows, df = linear_rows(spark)
    models = [EN.Penalty(0.3, 0.7, 1), EN.Penalty(1.0, 0.1, 2), EN.Penalty(0.5, 0.5)]
    fitted = EN.fit_models(df, 30, models, rounds=200, tolerance=1e-4)
    assert fitted.steps < 200 and fitted.violation.max() <= 1e-4
    m = models[0]
    mine = [r for r in rows if r[4] != m.fold]
    plain = spark.createDataFrame([(Vectors.sparse(30, ids, v), y, w) for ids, v, y, w, _ in mine], ["features", "label", "weight"])
    other = LogisticRegression(weightCol="weight", standardization=False, elasticNetParam=m.l1_share, regParam=1 / (m.c * len(mine)), maxIter=500, tol=1e-10).fit(plain)
    assert np.allclose(other.coefficients.toArray(), fitted.coefficients[:-1, 0], atol=1e-2)
    assert ((fitted.coefficients[:-1, 0] == 0) == (np.abs(other.coefficients.toArray()) < 1e-4)).mean() > 0.9
    # The certificate holds for other solvers too, and fails for other coefficients.
    theirs = np.append(other.coefficients.toArray(), other.intercept)[:, None]
    assert EN.violations(df, theirs, [m])[0] < 1e-3 < EN.violations(df, theirs + 0.1, [m])[0]


def test_grid_search_picks_by_mean_auc_and_refits(spark):
    rows, df = linear_rows(spark)
    models = EN.grid_models((0.01, 1.0), (0.5,), 3)
    best, table, fitted = EN.search(df, 30, models, rounds=20, tolerance=1e-2)
    got = {r["c"]: r["auc"] for r in table.collect()}
    for k, c in enumerate((0.01, 1.0)):
        aucs = []
        for fold in range(3):
            w = fitted.coefficients[:, 3 * k + fold]
            held = [(w[-1] + sum(w[i] * x for i, x in zip(ids, v)), y) for ids, v, y, _, f in rows if f == fold]
            pairs = [(a > b) + (a == b) / 2 for a, y in held if y for b, z in held if not z]
            aucs.append(sum(pairs) / len(pairs))
        assert got[c] == pytest.approx(sum(aucs) / 3)
    assert best.c == max(got, key=got.get)
    whole = EN.refit(df, 30, best, fitted, rounds=100, tolerance=1e-3)
    assert whole.violation[0] <= 1e-3 and whole.models[0].fold == -1
    with pytest.raises(ValueError):
        EN.fit_models(df.limit(0), 30, models)


# --- leaf-wise trees against a learner that splits one leaf at a time ------------------


def plain_boosting(x, y, w, cuts, s):
    """(feature, cut) of the splits and the leaf values of each tree, in the order of growth."""
    bins = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)], axis=1)
    p = (w * y).sum() / w.sum()
    margin, out = np.full(len(y), np.log(p / (1 - p))), []

    def best(rows):
        g, h = gradient[rows].sum(), curvature[rows].sum()
        top = None
        for k in range(x.shape[1]):
            for b in range(len(cuts[k])):
                low = rows & (bins[:, k] <= b)
                high = rows & ~low
                if min(low.sum(), high.sum()) < s.least_rows or min(curvature[low].sum(), curvature[high].sum()) < s.least_curvature:
                    continue
                gain = sum(max(abs(gradient[r].sum()) - s.l1, 0) ** 2 / (curvature[r].sum() + s.l2) for r in (low, high)) - max(abs(g) - s.l1, 0) ** 2 / (h + s.l2)
                if gain > 1e-9 and (top is None or round(gain, 9) > round(top[0], 9)):
                    top = gain, k, b, low, high
        return top

    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = w * (p - y), w * p * (1 - p)
        leaves = [(np.ones(len(y), bool), best(np.ones(len(y), bool)))]
        splits = []
        while len(leaves) < s.leaves and any(t for _, t in leaves):
            k = max((k for k, (_, t) in enumerate(leaves) if t), key=lambda k: leaves[k][1][0])
            _, (_, feature, b, low, high) = leaves.pop(k)
            splits.append((feature, float(cuts[feature][b])))
            leaves += [(low, best(low)), (high, best(high))]
        for rows, _ in leaves:
            g = gradient[rows].sum()
            margin[rows] -= s.step * np.sign(g) * max(abs(g) - s.l1, 0) / (curvature[rows].sum() + s.l2)
        out.append(splits)
    return out, 1 / (1 + np.exp(-margin))


def test_leafwise_trees_equal_one_leaf_at_a_time(spark):
    r = np.random.default_rng(3)
    x = np.stack([r.random(400), r.integers(0, 4, 400).astype(float), r.random(400) ** 2], axis=1)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 1) ^ (r.random(400) < 0.1)).astype(int)
    w = 1.0 + 0.5 * y
    df = spark.createDataFrame([(int(b), float(c), *map(float, a)) for a, b, c in zip(x, y, w)], "label int, weight double, a double, b double, c double")
    s = B.LeafwiseSettings(rounds=4, step=0.3, leaves=9, row_share=1.0, column_share=1.0, bins=16, write_every=2)
    columns = ("a", "b", "c")
    cuts = B.cut_points(df, columns, s.bins)
    assert all(0 < len(c) < 16 for c in cuts)
    nodes = B.fit_leafwise(df, s, columns).cache()
    want, probability = plain_boosting(x, y, w, cuts, s)
    for k, splits in enumerate(want):
        got = nodes.where((F.col("tree") == k + 1) & (F.col("feature") >= 0)).collect()
        assert sorted((n["feature"], n["cut"]) for n in got) == sorted(splits)
    got = T.with_probability(df, nodes, columns).select("prob_tree").collect()
    assert np.allclose([g[0] for g in got], probability)


def test_leafwise_awkward_tables(spark):
    schema = "label int, weight double, a double, b double"
    s = B.LeafwiseSettings(rounds=2, leaves=4, least_rows=1, row_share=1.0, column_share=1.0)
    with pytest.raises(ValueError):
        B.fit_leafwise(spark.createDataFrame([], schema), s, ("a", "b"))
    # One value everywhere: no split, the base alone.
    same = spark.createDataFrame([(i % 2, 1.0, 3.0, None) for i in range(20)], schema)
    only = B.fit_leafwise(same, s, ("a", "b")).collect()
    assert [(n["tree"], n["feature"], n["value"]) for n in only] == [(0, -1, 0.0)]
    # Missing and NaN values go above every cut, in training and in scoring.
    rows = [(int(i < 20), 1.0, None if i < 10 else float("nan") if i < 20 else float(i), 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    p = [r["prob_tree"] for r in T.with_probability(df, B.fit_leafwise(df, s, ("a", "b")), ("a", "b")).collect()]
    assert min(p[:20]) > 0.5 > max(p[20:])


def test_a_tree_table_may_be_empty_or_one_leaf(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    for rows, want in (([], 0.5), ([(0, 0, -1, None, -1, -1, 1.0)], 1 / (1 + math.exp(-1)))):
        assert T.with_probability(df, spark.createDataFrame(rows, T.NODES), ("a",)).first()["prob_tree"] == pytest.approx(want)


def test_a_broken_save_leaves_the_bundle_before(spark, tmp_path, monkeypatch):
    from vigilrow.plans import bundle as BU
    from vigilrow.plans.catalog import rule_nodes, rule_scaler

    folder = str(tmp_path / "bundles")
    with pytest.raises(FileNotFoundError):
        BU.ModelBundle.load(spark, folder)
    limits = spark.createDataFrame([(0.8, 0.4)], "blocking_threshold double, hunting_threshold double")
    first = BU.ModelBundle(rule_nodes(spark), rule_scaler(spark), limits)
    assert first.save(folder) == 1
    second = BU.ModelBundle(rule_nodes(spark).where("tree < 2"), rule_scaler(spark), limits)

    class Broken(Exception):
        pass

    def broken(*_, **__):
        raise Broken

    writer = type(limits.write)
    steps = [(writer, "parquet", n) for n in range(3)] + [(BU, "write_metadata", 0)]
    for owner, name, good in steps:
        kept, calls = getattr(owner, name), []

        def sometimes(*args, **more):
            calls.append(1)
            return broken() if len(calls) > good else kept(*args, **more)

        with monkeypatch.context() as patch:
            patch.setattr(owner, name, sometimes)
            with pytest.raises(Broken):
                second.save(folder)
        assert BU.ModelBundle.load(spark, folder).nodes.count() == first.nodes.count()
    assert second.save(folder) == 2
    assert BU.ModelBundle.load(spark, folder).nodes.count() == second.nodes.count()
    assert BU.ModelBundle.load(spark, folder, 1).nodes.count() == first.nodes.count()


def test_bundle_saves_loads_and_scores_a_scan(spark, tmp_path):
    from tests.conftest import files
    from vigilrow.plans import scan as Z
    from vigilrow.plans.bundle import ModelBundle

    random.seed(4)
    rows = []
    for i in range(200):
        bad = i % 2
        rows.append({f: 0.0 for f in FEATURES} | {"file_id": i, "label": bad, "exec_func_count": float(2 * bad), "entropy": random.gauss(4, 0.1)})
    trees = TR.train_trees(spark.createDataFrame(rows), M.TreeSettings(rounds=3, depth=2), oversample=False)
    ngrams = TR.train_ngrams(labelled(spark), M.LinearSettings(rounds=20))
    ModelBundle.of(trees, ngrams).save(str(tmp_path / "bundle"))
    bundle = ModelBundle.load(spark, str(tmp_path / "bundle"))
    texts = [("/a.php", "eval shell cmd eval shell cmd the x eval($a); exec($b);"), ("/b.php", "page title menu page title menu and or x page"), ("/c.png", "page")]
    judged = Z.scan(files(spark, *texts), bundle.scorer(), limits=bundle.limits("hunting"))
    got = {r["path"]: r for r in judged.collect()}
    assert got["/a.php"]["prob_tree"] > got["/b.php"]["prob_tree"] and got["/a.php"]["prob_ngram"] > 0.5 > got["/b.php"]["prob_ngram"]
    assert got["/c.png"]["status"] == "skipped_by_ext" and got["/a.php"]["exec_func_count"] == 2
    # The linear scorer is the model itself.
    from vigilrow.operators import ngram as N

    clean = labelled(spark, 20).withColumn("clean", F.col("code"))
    vectors = M.with_vectors(N.with_weights(clean, ngrams.vocabulary), ngrams.vocabulary.count())
    want = {r["file_id"]: r["p"] for r in M.bad_probability(ngrams.model, vectors, "p").collect()}
    more = labelled(spark, 20).withColumns({f: F.lit(0.0) for f in FEATURES})
    for r in bundle.scorer()(more).collect():
        assert r["prob_ngram"] == pytest.approx(want[r["file_id"]])
    with pytest.raises(TypeError):
        Z.scan(files(spark, *texts))


def test_sample_guard(spark):
    df = spark.createDataFrame([(1,), (0,)], "label int")
    with pytest.raises(ValueError):
        require_samples(df)
    with pytest.raises(RuntimeError):
        require_samples(df.limit(0))
    assert require_samples(df, 1) is df


def test_quantiles_of_many_columns_are_exact(spark):
    from vigilrow.operators.selection import quantiles

    r = np.random.default_rng(6)
    table = {
        "flag": (r.random(301) < 0.3).astype(float), "real": r.normal(size=301) * 1e6, "tiny": r.random(301) * 1e-300, "one": np.full(301, 7.0),
        "signs": r.choice([-0.0, 0.0, -1.5, 2.5], 301), "wide": np.concatenate([[-math.inf, math.inf], r.normal(size=299) * 10.0 ** r.integers(-9, 9, 299)]),
    }
    rows = [tuple(float(v[k]) for v in table.values()) + (None if k % 3 else float(k), None, float("nan") if k else 4.0) for k in range(301)]
    names = (*table, "some", "none", "nans")
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = quantiles(df, names, shares)
    table |= {"some": np.array([float(k) for k in range(301) if not k % 3]), "nans": np.array([4.0])}
    for name, values in table.items():
        want = [np.sort(values)[round(s * (len(values) - 1))] if (s * (len(values) - 1)).is_integer() else np.quantile(values, s) for s in shares]
        assert np.allclose(got[name], want, rtol=1e-12, atol=0), name
    assert got["none"] == (None,) * 5
    assert quantiles(df.limit(0), ("flag",), (0.5,)) == {"flag": (None,)}


def test_rare_terms_are_left_out_of_the_count_not_of_the_result(spark):
    texts = table(spark, SMALL, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("clean")).cache()
    rows = [r["clean"] or "" for r in texts.collect()]
    for block in (N.Block("char", (3, 4, 5), 40, 2, 0.6), N.Block("word", (1, 2, 3), 40, 3, 0.5), N.Block("char", (6,), 10**6, 2, 0.9)):
        files, uses = Counter(), Counter()
        for text in rows:
            found = N.count_terms(text, block)
            files.update(found.keys())
            uses.update(found)
        fits = [t for t in files if block.min_files <= files[t] <= block.max_share * len(rows)]
        best = sorted(fits, key=lambda t: (-uses[t], t))[: block.limit]
        got = N.fit_vocabulary(texts, block).collect()
        assert {(r["term"], r["files"], r["uses"]) for r in got} == {(t, files[t], uses[t]) for t in best}
    bounds = N.bucket_uses(texts, N.CHAR)
    wanted = bounds >= np.partition(bounds, -200)[-200]
    # Only the terms of some buckets leave the tasks, few of all.
    assert 0 < N.merged_counts(texts, N.CHAR, wanted).count() < N.merged_counts(texts, N.CHAR).count() / 10


@pytest.mark.parametrize("letters", [5, 3_000])
def test_piles_count_each_alphabet(letters, monkeypatch):
    """Term and place sorted as one number, where they fit in one; the same counts either way."""
    rng = random.Random(letters)
    lines = ["".join(chr(0x4E00 + rng.randrange(letters)) for _ in range(n)) for n in (0, 2, 400, 700)] * 2
    pile = N.Pile(lines, N.CHAR)
    if letters == 5:
        monkeypatch.setattr(N.np, "argsort", None)  # slow, and not needed here
    for n in (6, 3, 4, 5):  # hashes do not depend on what was asked before
        assert (pile.buckets(n) == N.Pile(lines, N.CHAR).buckets(n)).all()
    for n in (3, 4):
        terms, files, uses = pile.counts(n)
        expected = N._plain_counts(lines, n, N.CHAR)
        assert sorted(zip(terms, files, uses)) == sorted(zip(*expected))


def test_texts_are_cleaned_once_for_the_vocabulary(spark):
    from pyspark.sql import functions as F

    from vigilrow.operators import ngram as N

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(text):
        seen.add(1)
        return text

    rows = [(i, f"some words {i % 3} and {i % 5} more") for i in range(60)]
    texts = spark.createDataFrame(rows, "file_id long, code string").withColumn("clean", clean("code"))
    found = N.vocabulary(texts).select("block", "term", "files").collect()
    assert {(r["block"], r["term"]): r["files"] for r in found}["word", "0 and"] == 20
    assert seen.value == 60


def test_weights_leave_python_in_small_batches(spark, monkeypatch):
    texts = table(spark, SMALL, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("clean"), F.lit("x").alias("part"))
    texts = texts.unionByName(spark.createDataFrame([(-1, None, "x"), (-2, "", "x")], "file_id long, clean string, part string")).cache()
    vocab = N.vocabulary(texts).cache()
    monkeypatch.setattr(N, "_CELLS_AT_ONCE", 5_000)
    weighted = N.with_weights(texts, vocab, drop=("clean",))
    assert weighted.columns == ["file_id", "part", "weights"]
    # Rows wait neither for their batch in Python nor in a queue beside it.
    assert "EvalPython" not in weighted._jdf.queryExecution().executedPlan().toString()
    known = {b.name: {r["term"]: (r["term_id"], r["idf"]) for r in vocab.collect() if r["block"] == b.name} for b in (N.CHAR, N.WORD)}
    matchers = [N.Matcher(b, known[b.name]) for b in (N.CHAR, N.WORD)]
    want = {r["file_id"]: [N.weigh(r["clean"] or "", m) for m in matchers] for r in texts.collect()}
    for r in weighted.collect():
        ids, values = (np.concatenate(x).tolist() for x in zip(*want.pop(r["file_id"])))
        assert (r["weights"]["ids"], r["weights"]["values"]) == (ids, values)
    assert not want


def test_grid_reads_few_wide_rows_at_a_time(spark, monkeypatch):
    products = EN._products

    def few(batch, matrix):
        assert batch.num_rows <= 250
        return products(batch, matrix)

    monkeypatch.setattr(EN, "_products", few)
    data = [([k % 3], [1.0], k % 2, 1.0, k % 2) for k in range(700)]
    rows = spark.createDataFrame(data, "ids array<int>, values array<double>, label int, weight double, fold int").coalesce(1)
    models = [EN.Penalty(1.0, 0.5, k) for k in range(2)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(EN.violations(rows, np.zeros((4, 2)), models)) == 2
    EN.grid_auc(rows, EN.Fitted(models, np.zeros((4, 2)), np.zeros(2), 0))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"


def test_neighbour_search_sends_vectors_as_often_as_there_are_groups(spark, monkeypatch):
    monkeypatch.setattr(NB, "POINTS_PER_PIVOT", 10)
    monkeypatch.setattr(NB, "BLOCK_ROWS", 8)
    random.seed(5)
    points = {f"p{i}": [random.gauss(0, 1) for _ in range(24)] for i in range(400)}  # so many dimensions that no cell is ruled out
    df = spark.createDataFrame(list(points.items()), "vid string, vec array<double>").cache()
    sent = []
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *given: sent.append(self) or repartition(self, *given))
    found = NB.nearest(df, df, 5)
    # 40 cells of at least one block, 4 cores.
    assert len(sent) == 2
    for side, ids in zip(sent, ("q_ids", "p_ids")):
        assert side.select(F.sum(F.size(ids))).first()[0] <= 3 * 400
    got = {}
    for r in found.collect():
        got.setdefault(r["vid"], []).append((r["place"], r["nid"]))
    want = brute_nearest(points, 5)
    assert all([n for _, n in sorted(got[v])] == [b for _, b in near] for v, near in want.items())


def test_vocabulary_reads_few_texts_at_a_time(spark, monkeypatch):
    piles = N._piles

    def few(batches, block):
        def seen():
            for batch in batches:
                assert batch.num_rows <= 250
                yield batch

        return piles(seen(), block)

    monkeypatch.setattr(N, "_piles", few)
    texts = spark.createDataFrame([(f"some words {i % 7}",) for i in range(700)], "clean string").coalesce(1)
    assert {r["term"]: r["files"] for r in N.fit_vocabulary(texts, N.WORD).collect()}["words 3"] == 100


def test_importances_come_from_a_full_fit(spark, monkeypatch):
    from vigilrow.plans import catalog as C

    seen = []
    monkeypatch.setattr(C, "labelled_features", lambda *_: None)
    monkeypatch.setattr(TR, "train_trees", lambda rows, settings, oversample=True: seen.append((settings, oversample)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        C.QUERIES["model_tree_importances"](spark, SMALL)
    assert seen == [(M.TreeSettings(), True)] and M.TreeSettings().rounds == 800
