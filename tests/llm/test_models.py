"""Classifiers, mixing and the pipeline."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnspark.llm import mixing, quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(spark, tables):
    docs, labels = tables
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["predicted"] == got["quality"]).mean() > 0.97


def test_held_out_labels_arent_read(spark, tables):
    docs, labels = tables
    docs = docs.limit(600).cache()
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score_documents(docs, x).orderBy("doc_id").toPandas()["score"] for x in (labels, flipped))
    assert np.allclose(a, b)


def test_mahalanobis_agrees_with_the_density():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 4)), rng.normal(1.5, 2, (300, 4))])
    y = np.repeat([0, 1], [200, 300])
    m = quality.Discriminant.fit(x, y)
    z = np.clip((x - m.center) / m.scale, -quality.CLIP, quality.CLIP)
    logs = []
    for mean, f, o in zip(m.means, m.factors, m.offsets):
        cov = np.linalg.inv(f.T @ f)
        d = z - mean
        prior = o - 0.5 * -np.linalg.slogdet(cov)[1]
        logs.append(prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-(logs[1] - logs[0]) / 2)))
    assert ((m.score(x) > 0.5) == y).mean() > 0.8


def test_odd_texts_and_empty_labels(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "word " * 30_000, 0), (3, "word", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (2, None, None), (None, 1, 1), (1, 7, 7)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        got = quality.score_documents(df, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert got[0].score == got[1].score
        tox = toxicity.score_documents(df, labels).collect()
        assert len(tox) == 5 and all(0 <= r.p_toxic <= 1 for r in tox) and tox[0][1:] == tox[1][1:]
    assert toxicity.score_documents(df.limit(0), some).count() == 0 == quality.score_documents(df.limit(0), some).count()


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    train = labels.where(quality.fold(F.col("doc_id")) != 0)
    got = toxicity.score_documents(docs, train).join(labels.where(quality.fold(F.col("doc_id")) == 0), "doc_id").toPandas()
    assert got[got["toxic"] == 1]["is_toxic"].mean() > 0.85
    assert got[got["toxic"] == 0]["is_toxic"].mean() < 0.01
    kept = toxicity.drop_toxic(docs, train)
    assert kept.columns == docs.columns


def test_later_links_see_earlier_probabilities():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 40, 8)).astype(np.int32), np.ones(8, int)) for _ in range(300)]
    rows = [(b, c[: len(b)]) for b, c in rows]
    first = np.array([5 in b for b, _ in rows])
    second = np.array([9 in b for b, _ in rows]) | first
    chain = toxicity.Chain.fit(rows, np.stack([first, second], 1).astype(int), ("first", "second"))
    assert len(chain.links[1].weights) == len(chain.links[0].weights) + 1
    p = chain.predict(rows)
    assert ((p[:, 1] > 0.5) == second).mean() > 0.95


def test_a_fit_is_at_the_minimum():
    """Against Newton's method in double precision."""
    rng = np.random.default_rng(5)
    x = (rng.random((400, 12)) < 0.3).astype(np.float32)
    y = (x @ rng.normal(0, 2, 12) + rng.normal(0, 1, 400) > 0).astype(float)
    got = toxicity.Linear.fit(x, y)
    z, w = np.hstack([x.astype(float), np.ones((400, 1))]), np.zeros(13)
    ridge = np.diag([1.0] * 12 + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    assert np.allclose(got.weights, w[:-1], atol=0.02) and abs(got.bias - w[-1]) < 0.02


def test_kinds_are_found_in_the_data():
    rows, kind = [], []
    rng = np.random.default_rng(6)
    for k in range(240):
        own = k % 4  # three kinds of toxic rows, each with words of its own, and clean ones
        bins = np.unique(np.concatenate([rng.integers(1000, 1400, 12), own * 100 + rng.choice(20, 6, replace=False) if own < 3 else rng.integers(5000, 5400, 6)])).astype(np.int32)
        rows.append((bins, np.ones(len(bins), int)))
        kind.append(own)
    y = toxicity.category_labels(rows, (np.array(kind) < 3).astype(np.int8))
    assert (y[:, :-1].sum(1) == y[:, -1]).all()
    found = [set(y[np.array(kind) == k, :-1].argmax(1)) for k in range(3)]
    assert all(len(f) == 1 for f in found) and len(set.union(*found)) == 3


def test_folds_choose_features_without_their_own_rows(monkeypatch):
    """A feature that only the rows of one fold have can't help to predict that fold."""
    seen = []
    real = toxicity._strongest
    monkeypatch.setattr(toxicity, "_strongest", lambda rows, y, signed=False: seen.append(len(rows)) or real(rows, y, signed))
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 40, 8)).astype(np.int32), np.ones(8, int)) for _ in range(100)]
    rows = [(b, c[: len(b)]) for b, c in rows]
    y = np.array([5 in b for b, _ in rows]).astype(np.int8)
    toxicity.Chain.fit(rows, np.stack([y, y], 1), ("first", "second"))
    assert seen == [100] + [80] * toxicity.FOLDS


def plain_chain(chain, text):
    """The probabilities of one text, word by word and link by link."""
    raw = bytes(b if toxicity._WORD[b] else 32 for b in (text or "").encode())
    terms = {}
    for word in raw.split():
        kinds, _, _ = toxicity._tokens(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        for h in {int(x) for x in kinds[:, 0].tolist() if x}:
            terms[h % toxicity.SPACE] = terms.get(h % toxicity.SPACE, 0) + 1
    found = []
    for link in chain.links:
        z = link.bias
        for at, feature in enumerate(chain.kept.tolist()):
            if feature in terms:
                z += link.weights[at] * min(1 + math.log(terms[feature]), 3.0)
        z += sum(w * p for w, p in zip(link.weights[len(chain.kept) :], found, strict=True))
        found.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
    return found


def test_toxicity_against_brute_force(spark, tables):
    """The whole query on small tables: every row's probabilities computed one by one from the fitted chain."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    for d, text in docs.select("doc_id", "text").collect():
        want = plain_chain(chain, text)
        assert np.allclose(list(got[d][1:-1]), want, atol=1e-4) and got[d].is_toxic == (got[d].p_toxic > 0.5)


def test_an_id_of_many_rows_is_one_training_row(spark):
    rows = [(1, "good text here", 0)] + [(2, f"bad text {k % 2}", 0) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    sample = quality.labelled_sample(df, labels, "toxic", 100)
    assert sample.count() == 51 and quality.one_row_an_id(sample).count() == 2


def test_hashed_words_are_counted():
    ((bins, counts),) = toxicity.hashed_features(pa.array(["Bad, bad! (BAD) good"]))
    (bad,) = toxicity.term_bins(["bad"])
    assert counts[bins.tolist().index(bad)] == 3


def raked_cells(rng, shape=(4, 3, 2)):
    return [(f"s{a}", f"l{b}", f"t{c}", float(rng.integers(1, 100))) for a in range(shape[0]) for b in range(shape[1]) for c in range(shape[2]) if (a + b + c) % 5]


def test_raking_meets_the_marginals(spark):
    df = spark.createDataFrame(raked_cells(np.random.default_rng(2)), "source string, lang string, topic string, mass double")
    targets = {"source": mixing.tempered(0.0), "lang": mixing.tempered(0.5), "topic": mixing.tempered(0.2)}
    for share in (0.2, 0.5, 0.8):
        got = mixing.rake(df, targets, share)
        a = got.weights.toPandas()
        assert got.error < 1e-3 and a["probability"].between(0, 1).all() and (share > 0.2 or got.reached > 0.8)
        kept = (a["mass"] * a["probability"]).sum()
        assert np.isclose(kept / a["mass"].sum(), share, atol=1e-3)
        for d, target in targets.items():
            seen = a.groupby(d)["mass"].sum() / a["mass"].sum()
            goal = mixing._complete(target(seen.to_dict()), list(seen.index))
            real = mixing.feasible(np.array([goal[v] for v in seen.index]), seen.to_numpy() / share)
            real = seen + got.reached * (real - seen)
            assert np.allclose((a["mass"] * a["probability"]).groupby(a[d]).sum() / kept, real, atol=1e-3)


def test_raking_agrees_with_plain_fitting_where_no_bound_binds():
    rng = np.random.default_rng(3)
    mass = rng.uniform(1, 2, (3, 4, 2))
    codes = list(np.indices(mass.shape).reshape(3, -1))
    goals = [np.array([0.3, 0.33, 0.37]), np.array([0.25, 0.25, 0.25, 0.25]), np.array([0.45, 0.55])]
    p, reached, error = mixing.rake_cells(codes, mass.ravel(), goals, 0.2)
    w = mass.copy()
    for _ in range(500):
        for axis, goal in enumerate(goals):
            others = tuple(k for k in range(3) if k != axis)
            w = w * np.expand_dims(goal * w.sum() / w.sum(others), others)
    assert reached == 1 and np.allclose(p * mass.ravel(), (w / w.sum() * 0.2 * mass.sum()).ravel(), rtol=1e-3)


def test_a_rare_value_gives_all_and_no_more():
    mass = np.array([1000.0, 1000.0, 1.0])
    p, reached, error = mixing.rake_cells([np.array([0, 1, 2])], mass, [np.array([0.4, 0.4, 0.2])], 0.8)
    assert np.isclose(p[2], 1) and reached == 1 and np.isclose(p[0], p[1]) and np.isclose((p * mass).sum(), 0.8 * mass.sum())


def test_targets_that_contradict_each_other_are_approached():
    """Topic 1 is of language 1 only, so both can't be raised apart."""
    codes, mass = [np.array([0, 0, 1]), np.array([0, 1, 1])], np.array([60.0, 10.0, 30.0])
    p, reached, error = mixing.rake_cells(codes, mass, [np.array([0.75, 0.25]), np.array([0.55, 0.45])], 0.8)
    assert 0 < reached < 1 and error <= mixing.TOLERANCE and np.isclose((p * mass).sum(), 80, atol=0.05) and ((p >= 0) & (p <= 1)).all()
    nearer, worse = mixing._fitted(codes, mass, [np.array([0.75, 0.25]), np.array([0.55, 0.45])], 0.8, 400)
    assert worse > mixing.TOLERANCE


def test_too_many_cells_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 5)
    df = spark.createDataFrame(raked_cells(np.random.default_rng(2)), "source string, lang string, topic string, mass double")
    with pytest.raises(ValueError, match="more than 5 cells"):
        mixing.rake(df, mixing.DEFAULT_TARGETS)


def test_mixture_of_odd_rows(spark):
    rows = [(k, f"word{k % 3} " * (k % 7), "a" if k % 3 else None, None if k % 5 == 0 else "en", 1) for k in range(200)] + [(1, None, "a", "en", 1), (None, "x", "b", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")
    got = mixing.mix_documents(df).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 and r.tokens >= 1 for r in got)
    kept = mixing.sample_mixture(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_expected_and_sampled_shares_meet_the_targets(spark, tables):
    """On whole tables: the probabilities against targets computed here from the tokens alone."""
    got = mixing.mix_documents(tables[0]).toPandas()
    got["source"], got["lang"] = got["source"].fillna(mixing.NONE), got["lang"].fillna(mixing.NONE)
    total, expected, reached = got["tokens"].sum(), got["probability"] * got["tokens"], got["reached"].iloc[0]
    assert got["error"].iloc[0] < 1e-3 and reached > 0
    assert np.isclose(expected.sum() / total, mixing.SHARE, atol=1e-3)
    assert abs(got[got["kept"]]["tokens"].sum() / total - mixing.SHARE) < 0.03
    for d, power in (("source", 0.8), ("lang", 0.8), ("topic", 0.9)):
        seen = got.groupby(d)["tokens"].sum() / total
        goal = mixing.feasible((seen**power / (seen**power).sum()).to_numpy(), seen.to_numpy() / mixing.SHARE)
        goal = seen + reached * (goal - seen)
        assert np.abs(expected.groupby(got[d]).sum() / expected.sum() - goal).max() < 0.002
        assert np.abs(got[got["kept"]].groupby(d)["tokens"].sum().reindex(seen.index).fillna(0) / got[got["kept"]]["tokens"].sum() - goal).max() < 0.03


def test_topics_are_fitted_on_all_documents(spark):
    words = [[f"w{t}x{k}" for k in range(8)] for t in range(3)]
    rows = [(k, " ".join(words[k % 2])) for k in range(30_000)] + [(30_000, " ".join(words[2]))]
    centers = mixing.fit_topics(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    rare, _ = mixing._vectors(pa.array([" ".join(w) for w in words]))
    assert np.allclose((rare @ centers.T).max(1), 1, atol=1e-3)  # each has its centroid, the topic of one in 30,001 too
    assert sorted((rare @ centers.T).argmax(1).tolist()) == [0, 1, 2]
