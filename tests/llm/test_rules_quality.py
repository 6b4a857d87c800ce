import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import quality_rules as R
from cairn.llm import site_quality as S
from cairn.llm import textstats as X
from cairn.llm import toxicity as Q


def text(i, good=True):
    words = [f"w{(i * 31 + k * 17) % 997}x" for k in range(80)]
    return " ".join(words if good else [w + "###&&&" for w in words])


def plain_counts(t):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if __import__("re").search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(hit)


@pytest.mark.parametrize("t", [None, "", " \n\t", "a", "a b c a b c", "é é é é é", "x y z\x1cq", "l\nl\nl\n\n \n", "a a a a a a a b a a a", "Ünï #1 <b>|\n" * 7, "a b c d e f a b c x d e f"])
def test_counts(t):
    assert X.stats(t)[:5] == plain_counts(t)


def test_counts_on_documents(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000").limit(60).collect():
        assert X.stats(r.text)[:5] == plain_counts(r.text)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("made"))
    rows = [(i, text(i, i % 5 != 0), "s0" if i % 3 else "s1", "en", len(text(i))) for i in range(300)]
    rows += [(1000, None, None, None, 0), (1001, "", "s0", "en", 0), (None, text(3), "s0", None, 9), (7, text(7), "s1", "en", 3), (2000, "word " * 30_000, "s9", "xx", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("host_rate", F.lit("x")).withColumn("score", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(0, 300, 2)] + [(None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    e = str(tmp_path_factory.mktemp("empty"))
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{e}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{e}/labels.parquet")
    return d, e


def test_rules(spark, made):
    rows = R.rules_query(spark, made[0]).collect()
    assert len(rows) == 305
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sum(by[i][0].kept == (i % 5 != 0) for i in range(300)) >= 297 and len({tuple(r) for r in by[7]}) == 1
    assert by[1000][0].base_failed and not by[1001][0].kept and by[2000][0].base_failed and by[2000][0].n_words == 30_000
    assert R.rules_query(spark, made[1]).count() == 0


def test_rules_without_labels_use_the_base_rules_alone(spark, made):
    stats = R.with_stats(spark.read.parquet(f"{made[0]}/documents.parquet").select("doc_id", "text"))
    got = R.scored(stats, R.fit(stats, spark.read.parquet(f"{made[1]}/labels.parquet")))
    assert all(r["__rules"].kept != r["__rules"].base_failed for r in got.collect())


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 7))
    f = R.Forest(x)
    assert f.score(np.full((1, 7), 8.0))[0] > np.quantile(f.score(x), 0.995)
    assert (f.score(x) == R.Forest(x).score(x)).all()


def plain_path(tree, row, at=0, depth=0):
    """The path length of a row by recursion; rest(n) = 2 H(n - 1) - 2 (n - 1) / n is the mean for n rows in a leaf."""
    feature, cut, left, right, length = tree
    if left[at] == at:
        assert length[at] >= depth
        return length[at]
    return plain_path(tree, row, left[at] if row[feature[at]] < cut[at] else right[at], depth + 1)


def test_scores_are_path_lengths_alone():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)) * [1, 5, 0.1, 1]
    f = R.Forest(x, trees=20, drawn=64)
    rows = np.vstack([x[:30], rng.normal(size=(30, 4)) * 100])
    want = [np.mean([plain_path(t, r) for t in f.trees]) for r in rows]
    assert np.allclose(f.path_lengths(rows), want)
    c = 2 * (np.log(63) + np.euler_gamma) - 2 * 63 / 64
    assert np.allclose(f.score(rows), [2 ** (-w / c) for w in want])


def test_trees_hold_their_rows_once():
    x = np.random.default_rng(3).normal(size=(64, 3))
    f = R.Forest(x, trees=5, drawn=64)
    for feature, cut, left, right, length in f.trees:
        def leaves(rows, at, depth):
            if left[at] == at:
                rest = 0 if len(rows) <= 1 else 1 if len(rows) == 2 else 2 * (np.log(len(rows) - 1) + np.euler_gamma) - 2 * (len(rows) - 1) / len(rows)
                assert abs(length[at] - depth - rest) < 1e-6 and (depth == f.depth or len(rows) == 1)
                return len(rows)
            side = rows[:, feature[at]] < cut[at]
            assert 0 < side.sum() < len(rows) and rows[side, feature[at]].max() < cut[at] <= rows[~side, feature[at]].min()
            return leaves(rows[side], left[at], depth + 1) + leaves(rows[~side], right[at], depth + 1)

        assert leaves(x, 0, 0) == 64


def test_rules_catch_labelled_rows_and_keep_the_others(spark):
    d = "/root/testdata/sf0.1"
    got = R.rules_query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed and quality is not null").select("kept", "quality").collect()
    bad, good = [r.kept for r in got if not r.quality], [r.kept for r in got if r.quality]
    assert np.mean(bad) < 0.1 and np.mean(good) > 0.99


def test_cut_without_bad_labels_is_the_good_rows_quantile():
    hist = [(b, 10, 0) for b in range(100)]
    assert R.threshold(hist, 1000, 0.02) == 98 and R.threshold([(5, 10, 0)], 1000, 0.02) == 6
    assert R.threshold([(5, 0, 3)], 1000, 0.02) == 1001 and R.threshold([(5, 10, 0), (9, 1, 0), (3, 0, 5)], 1000, 0.02) == 1001


def test_stages_keep_columns(spark, made):
    docs = spark.read.parquet(f"{made[0]}/documents.parquet")
    for stage in (R.rules_stage, S.quality_stage):
        out = stage(spark, docs, made[0])
        assert out.schema == docs.schema
        ids = [r.doc_id for r in out.collect()]
        assert ids.count(7) == 2 and 6 in ids and sum(i in ids for i in range(0, 300, 5)) <= 3
        assert stage(spark, docs.limit(0), made[0]).count() == 0


def test_quality(spark, made):
    rows = {r.doc_id: r for r in S.quality_query(spark, made[0]).collect()}
    assert len(rows) == 304 and all(rows[i].kept == (i % 5 != 0) for i in range(300))
    assert rows[1000].host == "" and 0 <= rows[1000].score <= 1
    assert S.quality_query(spark, made[1]).count() == 0


def plain_pull(groups):
    """groups: (parent, n, k). One over the prior's strength, from sums over each parent's groups."""
    over = room = 0.0
    for parent in {g[0] for g in groups}:
        own = [(n, k) for p, n, k in groups if p == parent]
        total = sum(n for n, _ in own)
        p = min(max(sum(k for _, k in own) / total, 1e-6), 1 - 1e-6)
        over += sum(n * (k / n - p) ** 2 for n, k in own) - p * (1 - p) * (len(own) - 1)
        room += p * (1 - p) * (total - sum(n * n for n, _ in own) / total - (len(own) - 1))
    if room <= 0 or over <= 0:
        return 0.0
    rho = min(over / room, 0.5)
    return min(rho / (1 - rho), 1.0)


def test_quality_scores_match_plain_sums(spark, made):
    docs = spark.read.parquet(f"{made[0]}/documents.parquet")
    rows = S.materialise(S.prepared(docs, "source", "lang").select("doc_id", "__site"), "t")
    model, paths = S.fit(rows, spark.read.parquet(f"{made[0]}/labels.parquet"))
    base = float(np.log(model.base / (1 - model.base)))
    label = {i: int(i % 5 != 0) for i in range(0, 300, 2)}
    got = S.scored(rows, model, paths).select("doc_id", "__site.host", "__site.path", "__quality.*").collect()
    n, k = {}, {}
    for r in got:
        known = r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 5 != 0
        good = label[r.doc_id] if known else 1 / (1 + np.exp(-(r.evidence + base)))
        for key in ((), (r.host,), (r.host, r.path)):
            n[key], k[key] = n.get(key, 0) + 1, k.get(key, 0.0) + good
    rate = k[()] / n[()]
    host_pull = plain_pull([((), n[x], k[x]) for x in n if len(x) == 1])
    path_pull = plain_pull([(x[0], n[x], k[x]) for x in n if len(x) == 2])
    assert abs(model.rate - rate) < 1e-9 and abs(model.host_pull - host_pull) < 1e-9 and abs(model.path_pull - path_pull) < 1e-9
    for r in got:
        own = 1 / (1 + np.exp(-(r.evidence + base)))
        host = (max(k[(r.host,)] - own, 0) * host_pull + rate) / ((n[(r.host,)] - 1) * host_pull + 1)
        path = (max(k[(r.host, r.path)] - own, 0) * path_pull + host) / ((n[(r.host, r.path)] - 1) * path_pull + 1)
        assert abs(r.host_rate - host) < 1e-9 and abs(r.path_rate - path) < 1e-9
        assert abs(r.score - 1 / (1 + np.exp(-(r.evidence + np.log(path / (1 - path)))))) < 1e-6 and r.kept == (min(int((1 - r.score) * S.BINS), S.BINS) < model.cut)


def test_sites_decide_where_texts_are_alike(spark, tmp_path):
    """Hosts h0 to h5 are good, h6 and h7 bad, and no text says so; path p9 of the good host h0 is bad. One host has one row."""
    d, bad = str(tmp_path), lambda i: i % 8 > 5 or (i % 8 == 0 and i % 3 == 0)
    rows = [(i, text(i % 37), f"h{i % 8}", "p9" if i % 3 == 0 else "p1") for i in range(2400)] + [(9000, text(1), "new", "p1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not bad(i)), 0) for i in range(0, 2400) if i // 24 % 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in S.quality_query(spark, d).collect()}
    assert all(got[i].kept != bad(i) for i in range(2400)) and got[9000].kept
    assert got[6].host_rate < 0.5 < got[1].host_rate and got[0].path_rate < 0.5 < got[8].path_rate and got[6].path_rate < got[9000].path_rate < got[1].path_rate
    rows = S.materialise(S.prepared(spark.read.parquet(f"{d}/documents.parquet"), "source", "lang"), "t")
    alone = S.scored(rows, *S.fit(rows, spark.read.parquet(f"{d}/labels.parquet"), sites=False))
    assert sum(r["__quality"].kept == bad(r.doc_id) for r in alone.where("doc_id < 2400").collect()) > 100


def test_prior_strength_follows_the_spread(spark):
    def pull(rates, n=100):
        k = [n * r for r in rates]
        rows = [(0, n, float(x), n * len(k), float(sum(k))) for x in k]
        got = S.pull(spark.createDataFrame(rows, "parent int, n long, k double, parent_n long, parent_k double"))
        assert abs(got - plain_pull([(0, n, x) for x in k])) < 1e-12
        return got

    assert pull([0.5] * 4) == 0.0 and pull([0.5]) == 0.0 and pull([0.0, 1.0]) == 1.0
    assert 0 < pull([0.45, 0.65, 0.5, 0.4]) < pull([0.3, 0.7, 0.4, 0.6]) < 1


def test_toxicity_learns_a_word(spark, tmp_path):
    d = str(tmp_path)
    rows = [(i, text(i) + (" vile" if i % 4 == 0 else ""), "en") for i in range(600)] + [(5000, None, "en"), (5001, "", "en"), (None, "vile", "en"), (8, text(8) + " vile", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = Q.toxicity_query(spark, d).collect()
    assert len(got) == 604
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = Q.toxicity_query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    good, bad = [r.score for r in got if not r.toxic], [r.score for r in got if r.toxic]
    auc = np.mean([np.mean([b > g for g in good]) for b in bad])
    assert auc > 0.95 and np.mean([r.predicted for r in got if not r.toxic]) < 0.01


def test_toxicity_without_both_labels():
    one = np.array([1, 2], np.int32)
    assert Q.train([one, one], [0, 0])[2] == -30.0 and Q.train([], [])[2] == 0.0 and Q.train([one], [1])[2] == 0.0


def test_toxicity_of_nothing_long_texts_and_clashing_columns(spark, made, tmp_path):
    assert Q.toxicity_query(spark, made[1]).collect() == []
    got = Q.toxicity_query(spark, made[0]).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001]
    d = str(tmp_path)
    spark.read.parquet(f"{made[0]}/documents.parquet").write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{made[1]}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    assert {r.score for r in Q.toxicity_query(spark, d).collect()} == {0.5}


def test_training_rows_are_each_id_once_within_the_bounds(spark, made):
    docs, labels = (spark.read.parquet(f"{made[0]}/{t}.parquet") for t in ("documents", "labels"))
    feats, y = Q.training_rows(docs.union(docs), labels)
    ids = [i for i in range(0, 300, 2) if i != 4 and zlib.crc32(str(i).encode()) % 5] + ([4] if zlib.crc32(b"4") % 5 else [])
    assert len(feats) == len(y) == len(ids) and sum(y) == sum(i % 7 == 0 for i in ids)
    h = Q.Hasher()
    assert sorted(f.tolist() for f in feats) == sorted(h(text(i, i % 5 != 0)).tolist() for i in ids)
    some, _ = Q.training_rows(docs, labels, sample=20)
    assert len(some) == 20 and all((a == b).all() for a, b in zip(some, feats))
    few, _ = Q.training_rows(docs, labels, most=sum(map(len, feats[:7])) + 1)
    assert len(few) == 7


def test_places_left_out_have_no_weight():
    rng = np.random.default_rng(5)
    feats = [np.unique(rng.zipf(1.3, 40) % 3000).astype(np.int32) for _ in range(300)]
    y = [int(0 in f or 7 in f) for f in feats]
    at, w, b = Q.train(feats, y)
    m, order = Q.Ftrl(), np.random.default_rng(3)
    for _ in range(Q.PASSES):
        for i in order.permutation(len(feats)):
            m.learn(feats[i], y[i])
    all_w = m.weights(slice(None))
    assert len(at) and np.array_equal(at, np.flatnonzero(all_w)) and np.allclose(w, all_w[at]) and abs(b - m.intercept()) < 1e-9


def test_ftrl_update_matches_a_plain_one():
    rows = [("a b c", 1), ("b c d", 0), ("a a x", 1)] * 4
    h, m = Q.Hasher(), Q.Ftrl()
    z, n, bz, bn = {}, {}, 0.0, 0.0
    for t, y in rows:
        at = h(t)
        w = {i: (0 if abs(z.get(i, 0)) <= Q.L1 else -(z[i] - np.sign(z[i]) * Q.L1) / ((Q.BETA + n[i] ** 0.5) / Q.ALPHA + Q.L2)) for i in at}
        b = -bz / ((Q.BETA + bn**0.5) / Q.ALPHA)
        g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - y
        for i in at:
            s = ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / Q.ALPHA
            z[i] = z.get(i, 0) + g - s * w[i]
            n[i] = n.get(i, 0) + g * g
        s = ((bn + g * g) ** 0.5 - bn**0.5) / Q.ALPHA
        bz, bn = bz + g - s * b, bn + g * g
        m.learn(at, y)
    assert all(abs(m.z[i] - z[i]) < 1e-9 for i in z) and abs(m.bz - bz) < 1e-9
