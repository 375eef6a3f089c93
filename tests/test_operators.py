import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.operators import codebook, neighbors, network, pairs, search, splits, stats, submat
from foldline.operators.network import Model


def chain(spark, ys, valid=None):
    rows = [("c", i, True if valid is None else valid[i], 0.0, float(y), 0.0) for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "chain string, idx int, valid boolean, x double, y double, z double")


def test_nearest(spark):
    rows = chain(spark, [0, 0, 1.2, 2.5, 15, 0])
    at = lambda **k: {r.idx: r.partner for r in neighbors.nearest(rows, list("xyz"), **k).collect()}[2]
    assert (at(), at(min_separation=2, fall_back=20), at(min_separation=2, fall_back=10)) == (1, 4, 1)
    three = neighbors.nearest(chain(spark, [0, 1, 2]), list("xyz")).collect()
    assert all(r.partner is None for r in three)


def test_descriptor_mask(spark):
    ca = [(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 1, 0), (4, 2, 0)]
    rows = spark.createDataFrame([("c", i, True, [float(x) for x in p]) for i, p in enumerate(ca)], "chain string, idx int, valid boolean, ca array<double>")
    partners = spark.createDataFrame([("c", i, p) for i, p in enumerate([3, 3, 3, 1, 1])], "chain string, idx int, partner int")
    got = {r.idx: r for r in neighbors.descriptors(rows, partners).collect()}
    assert set(got) == {1, 2, 3} and got[2].f8 == 1


TURN = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])


def by_svd(fixed, moving):
    """The status and distances of one alignment by a singular value decomposition."""
    if len(fixed) < 3:
        return pairs.TOO_FEW, None
    if not (np.isfinite(fixed).all() and np.isfinite(moving).all()):
        return pairs.NOT_FINITE, None
    a, b = fixed - fixed.mean(0), moving - moving.mean(0)
    if min(np.linalg.svd(m, compute_uv=False)[1] for m in (a, b)) < 1e-6:
        return pairs.RANK, None
    u, _, vt = np.linalg.svd(b.T @ a)
    turn = u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt
    return None, np.sqrt((((b @ turn) - a) ** 2).sum(1))


def test_superposed(spark):
    rng = np.random.default_rng(123)
    a = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]])
    line = np.outer(np.arange(6), [0.3, -1.7, 2.9]) + 40
    flat = rng.standard_normal((9, 3)) * [5, 5, 0]
    far = rng.standard_normal((300, 3)) * 20 + 500
    sets = {
        "moved": (a, a @ TURN.T + [10, -5, 2]), "mirror": (a, a * [-1, 1, 1]), "line": (line, a[[0, 1, 2, 3, 0, 1]]), "line2": (far[:6], line), "place": (np.ones((3, 3)), a[:3]), "two": (a[:2], a[:2]), "nan": (a, np.full((4, 3), np.nan)),
        "inf": (np.where(a > 0, np.inf, a), a), "flat": (flat, flat[:, ::-1] + 0.01 * rng.standard_normal((9, 3))), "far": (far, far @ TURN.T + 0.5 * rng.standard_normal((300, 3))), "turned": (far, -far), "same": (far, far),
    }
    for k in range(30):
        n = int(rng.integers(3, 40))
        sets[f"r{k}"] = (rng.standard_normal((n, 3)) * 10, rng.standard_normal((n, 3)) * 10)
    rows = [(name, k, [float(v) for v in x[k]], [float(v) for v in y[k]], "kept") for name, (x, y) in sets.items() for k in range(len(x))]
    rows += [("null", k, [1.0, None, 2.0] if k else None, [0.0, 1.0, 2.0], "kept") for k in range(4)] + [(None, k, [float(v) for v in a[k]], [float(v) for v in a[k]], "kept") for k in range(4)]
    frame = spark.createDataFrame(rows, "alignment_id string, k int, x_ca array<double>, y_ca array<double>, status2 string").repartition(4)
    got = {}
    found = pairs.superposed(frame)
    assert found.columns == [*frame.columns, "ca_dist", "status"] and dict(found.dtypes)["ca_dist"] == "float"
    for r in found.collect():
        got.setdefault(r.alignment_id, {})[r.k] = (r.status, r.ca_dist)
    for name, (x, y) in sets.items():
        status, d = by_svd(x, y)
        assert {s for s, _ in got[name].values()} == {status}, name
        if d is None:
            assert {v for _, v in got[name].values()} == {None}
        else:
            assert [got[name][k][1] for k in range(len(d))] == pytest.approx(d, rel=1e-5, abs=2e-5), name
    assert got["null"][0] == (pairs.NOT_FINITE, None) and len(got[None]) == 4 and got[None][1][0] is None


def test_cap_and_mirror(spark):
    rows = spark.createDataFrame([("a", k, k, k + 1, "s", "t") for k in range(10)], "alignment_id string, k int, i int, j int, sid1 string, sid2 string")
    assert pairs.capped(rows, 8, 1).count() == 4 and pairs.capped(rows, None, 1).count() == 10
    seed = pairs.seed_of("s", "t", "10P", 42)
    assert spark.range(1).select(pairs.cap_seed(F.lit("s"), F.lit("t"), F.lit("10P"), 42)).first()[0] == seed
    exact = pairs.capped_exactly(rows.withColumn("cap_seed", F.lit(seed)), 8).orderBy("place").collect()
    assert [r.k for r in exact] == np.random.default_rng(seed).choice(10, 4, replace=False).tolist()
    both = pairs.mirrored(rows, [("i", "j"), ("sid1", "sid2")]).collect()
    assert len(both) == 20 and {(r.i, r.j, r.sid1) for r in both if r.dir == 1 and r.k == 0} == {(1, 0, "t")}


def test_counts(spark):
    a = spark.createDataFrame([("x", "p", "q", "3P")], "alignment_id string, sid1 string, sid2 string, cigar string")
    s = spark.createDataFrame([("p", "ABC"), ("q", "BCD")], "sid string, seq string")
    met = submat.aligned_letters(a, s)
    as_set = lambda rows: {(r.a, r.b, r.n) for r in rows.collect()}
    assert as_set(submat.joint_counts(met, "ABCD")) == {("A", "B", 1), ("B", "A", 1), ("B", "C", 1), ("C", "B", 1), ("C", "D", 1), ("D", "C", 1)}
    assert as_set(submat.lagged_counts(met, "ABCD")) == {("B", "B", 1), ("C", "A", 1), ("C", "C", 1), ("D", "B", 1)}
    counts = spark.createDataFrame([(x, y, 3 * i + j + 1) for i, x in enumerate("ABC") for j, y in enumerate("ABC")], "a string, b string, n long")
    for gone, into in (("C", "B"), ("A", "C")):
        merged = submat.merge_states(counts, gone, into)
        assert merged.count() == 4 and merged.agg(F.sum("n")).first()[0] == 45
    assert submat.mutual_information(counts.where("n > 99")).first().mi == 0
    lines = [r.value for r in submat.matrix_lines(counts.withColumnRenamed("n", "score")).orderBy("line_no").collect()]
    assert lines == ["    A   B   C", "A   1   2   3", "B   4   5   6", "C   7   8   9"]


def test_statistics(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (1.0, 6.0)], "a double, b double")
    fit = {r.feature: r for r in stats.standardizer(rows, ["a", "b"], 1e-5).collect()}
    assert fit["a"].std == 1e-5 and fit["b"].mean == 4
    assert stats.standardize(rows, ["b"]).orderBy("b").first().b == pytest.approx(-1.224744871)
    five = spark.createDataFrame([(5.0,), (4.5,), (0.0,)], "x double")
    assert [r.n for r in stats.distance_histogram(five, "x").collect()] == [1, 0, 0, 0, 0, 1, 1]
    assert [r.n for r in stats.distance_histogram(five, "x", closed=True).collect()] == [1, 0, 0, 0, 0, 2, 1]


def test_smith_waterman():
    def plain(a, b, m, o, e):
        h, x, y = (np.full((len(a) + 1, len(b) + 1), f) for f in (0, -(10**6), -(10**6)))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                x[i, j] = max(x[i - 1, j] - e, h[i - 1, j] - o)
                y[i, j] = max(y[i, j - 1] - e, h[i, j - 1] - o)
                h[i, j] = max(0, h[i - 1, j - 1] + m[a[i - 1], b[j - 1]], x[i, j], y[i, j])
        return int(h.max())

    rng = np.random.default_rng(0)
    m = rng.integers(-4, 6, (5, 5))
    m = m + m.T
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(0, 30)), rng.integers(0, 5, rng.integers(1, 30))
        assert search.smith_waterman(a, b, m) == plain(a, b, m, 8, 2)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    left_by_both = 0
    for _ in range(150):
        m = rng.integers(-7, 6, (5, 5)) + np.eye(5, dtype=int) * 3
        a, many = rng.integers(0, 5, rng.integers(1, 25)), [rng.integers(0, 5, rng.integers(0, 25)) for _ in range(6)]
        count = lambda s: np.bincount(s, minlength=5)
        exact = search.smith_waterman_many(a, many, m)
        counts, diagonals = search.count_bounds(np.array([count(a)]), np.array([count(b) for b in many]), m)[0], search.diagonal_bounds(a, many, m)
        assert (counts >= exact).all() and (diagonals >= exact).all()
        left_by_both += int(((counts >= 12) & (diagonals >= 12) & (exact < 12)).sum())
    assert left_by_both < 450  # of 900


def test_pairs_below_the_least_score_are_not_aligned(spark, monkeypatch):
    rng = np.random.default_rng(6)
    text = lambda letters, n: "".join(rng.choice(list(letters), n))
    seqs = [(f"p{k}", text("AB", 40)) for k in range(6)] + [(f"r{k}", text("CD", 40)) for k in range(6)] + [(f"s{k}", text("ABCDE", 6)) for k in range(6)] + [("none", ""), ("odd", "xyz?"), ("mixed", text("AB", 20) + text("CD", 20))]
    m = np.where(np.eye(5, dtype=bool), 5, -4)
    code = {c: k for k, c in enumerate("ABCDE")}
    read = lambda s: np.array([code[c] for c in s if c in code], dtype=int)
    want = {(q, t): x for q, a in seqs for t, b in seqs if (x := search.smith_waterman(read(a), read(b), m)) >= 40}
    rows = spark.createDataFrame(seqs, "sid string, seq string")
    for block in (4, 256):
        monkeypatch.setattr(search, "BLOCK", block)
        assert {(r.query, r.target): r.score for r in search.all_against_all(rows, "ABCDE", m, 40).collect()} == want
    some = rows.where("sid like 'p%'")
    assert {(r.query, r.target): r.score for r in search.all_against_all(rows, "ABCDE", m, 40, some).collect()} == {k: v for k, v in want.items() if k[0][0] == "p"}
    seen = {r.query: r for r in search.screening(rows, "ABCDE", m, 40).collect()}
    assert len(seen) == len(seqs) and {r.pairs for r in seen.values()} == {len(seqs)}
    assert seen["s1"].counted == seen["none"].counted == seen["odd"].counted == 0 and seen["p1"].counted <= 7 and all(r.aligned <= r.counted for r in seen.values())
    assert sum(r.aligned for r in seen.values()) >= len(want)


def test_all_against_all(spark):
    rows = spark.createDataFrame([(f"s{k}", "AABBC" * (k % 3 + 1)) for k in range(7)], "sid string, seq string")
    m = np.array([[5, -2, -2], [-2, 5, -2], [-2, -2, 5]])
    got = {(r.query, r.target): r.score for r in search.all_against_all(rows, "ABC", m, least=1).collect()}
    assert len(got) == 49 and got["s0", "s0"] == 25 and got["s1", "s2"] == 50


def test_splits(spark):
    sids = spark.createDataFrame([("d1qksa1", 0), ("d1gwua_", 1), ("d1i17a_", 2), ("d_fallback", 3)], "sid string, position int")
    lookup = spark.createDataFrame([("d1qksa1", "a.3.1.2"), ("d1gwua_", "a.3.1.5"), ("d1i17a_", "b.1.1.1")], "sid string, class string")
    found = {r.sid: r.group_id for r in splits.groups(sids, lookup).collect()}
    assert found == {"d1qksa1": "a.3.1", "d1gwua_": "a.3.1", "d1i17a_": "b.1.1", "d_fallback": "_fal"}
    rows = splits.groups(sids, lookup).join(sids, "sid")
    assert {r.split for r in splits.split_by_shuffle(rows, 0.4, 42).collect()} == {"train", "val"}
    assert [len(x) for x in splits.shuffled_chunks([str(k) for k in range(11)], 4, 1)] == [3, 3, 3, 2]
    with pytest.raises(ValueError):
        splits.groups(sids, lookup, "species")


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = network.Mlp(4, 8, 3, 2, rng)
    x, d = rng.standard_normal((5, 4)), rng.standard_normal((5, 3))
    net.forward(x)
    dx, grads = net.backward(d)
    assert [g.shape for g in grads] == [w.shape for w in net.weights]
    loss = lambda: float((net.forward(x) * d).sum())
    for w, g in zip(net.weights, grads):
        at = tuple(rng.integers(0, s) for s in w.shape)
        keep = w[at]
        w[at] = keep + 1e-6
        up = loss()
        w[at] = keep - 1e-6
        down = loss()
        w[at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("kind, gradient", [("fsq", "ste"), ("ema_vq", "ste"), ("ema_vq", "rotation")])
def test_training_and_export(tmp_path, kind, gradient):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((256, 10))
    model = Model.fresh(0, kind, n_states=8, z_dim=3)
    log = network.train(model, (x, x), (x[:64], x[:64]), epochs=6, batch=64, gradient=gradient)
    assert log[-1]["train_loss"] < log[0]["train_loss"] and {"epoch", "train_loss", "val_loss", "perplexity", "dead_states"} == set(log[0])
    model.save(str(tmp_path))
    again = Model.load(str(tmp_path))
    assert (again.encode(x) == model.encode(x)).all() and model.encode(x).max() < model.config["n_states"]
    with pytest.raises(ValueError):
        network.train(model, (x, x), (x, x), batch=1000)
    (tmp_path / "scaler.json").write_text('{"mean": [0], "std": [1]}')
    with pytest.raises(ValueError):
        Model.load(str(tmp_path))


def test_model_limits():
    with pytest.raises(ValueError):
        Model.fresh(quantizer="ema_vq", n_states=51)
    with pytest.raises(ValueError):
        Model.fresh(quantizer="kd")
    m = Model.fresh(quantizer="ema_vq", z_dim=4)
    assert sum(w.size for net in (m.encoder, m.decoder) for w in net.weights) == 44_430


def test_dead_code_restarts():
    ema = codebook.MovingAverage(np.array([[1.0, 0], [0, 1], [-1, 0]]), decay=0.5, warm_up=2)
    for z in ([[1, 0.1], [0.1, 1]], [[1, 0.1], [0.1, 1]], [[5, -5], [5, -5]]):
        ema.update(np.array(z, float))
    assert np.allclose(ema.codes[2], np.array([1, -1]) / np.sqrt(2))


def test_batches_span_alignments():
    ids = np.repeat(np.arange(20), 50)
    found = list(network.batches_by_alignment(ids, 64, 8, 1, 0))
    assert len(found) == 15 and all(len(np.unique(ids[b])) >= 8 for b in found)
    assert len(np.unique(np.concatenate(found))) == 15 * 64


def test_jitter():
    c = np.zeros((4, 3), np.float32)
    out = network.jitter(c, np.array([True, False, True, True]), 0.5, np.random.default_rng(0))
    assert (out[1] == 0).all() and (out[0] != 0).any() and network.jitter(c, np.ones(4, bool), 0, None) is c
