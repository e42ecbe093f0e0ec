import random

from tarnspark.llm import ngram_join
from tarnspark.llm.components import components


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def roots(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def plain(rows, k, percent):
    own, ids = roots(rows, k, percent), {}
    for r, (d, _) in zip(own, rows):
        if d is not None:
            ids[r] = min(ids.get(r, d), d)
    return sorted(((d, len(shingles(t, k)), ids.get(r)) for r, (d, t) in zip(own, rows)), key=str)


def corpus(seed=5):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(60))
    boiler = [word() for _ in range(40)]
    rows = []
    for k in range(60):
        base = [word() for _ in range(rnd.choice([1, 2, 5, 30, 80]))]
        if k % 3 == 0:
            base[5:5] = boiler
        for n in range(rnd.choice([1, 1, 2, 4])):
            t = list(base)
            for _ in range(n):  # drifts, so chains form
                t[rnd.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    family = [word() for _ in range(60)]
    for n in range(60):  # a large group of near copies
        t = list(family)
        t[rnd.randrange(60)] = word()
        rows.append((len(rows), " ".join(t).upper() if n % 2 else "\t".join(t)))
    rows += [(len(rows) + n, "the same text again and again") for n in range(20)]
    rnd.shuffle(rows)
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (None, "the same text again and again"), (None, "alone with no id at all"), (7, "a second text for id seven with words"), (6000, "w " * 5000)]


def test_components_are_those_of_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string")
    for k, percent in ((4, 85), (5, 80)):
        got = ngram_join.join_documents(df, k, percent)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == plain(rows, k, percent)


def test_small_parts_and_few_bands_lose_nothing(spark, monkeypatch):
    """Groups in many parts, and hardly any group at all: the links found by opening groups make up for it."""
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "PART_TOKENS", 200)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_documents(df, 4, 85).collect()), key=str) == plain(rows, 4, 85)
    monkeypatch.setattr(ngram_join, "star_pairs", lambda nodes, percent: nodes.sparkSession.createDataFrame([], "a binary, b binary"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_documents(df, 4, 85).collect()), key=str) == plain(rows, 4, 85)


def test_sketches_never_rule_out_a_link():
    import numpy as np

    rnd = np.random.default_rng(4)
    ruled = 0
    for n in (1, 2, 30, 300, 5000):
        for share in (0.0, 0.01, 0.05, 0.08, 0.5):
            a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: len(a) - int(share * n)], rnd.integers(0, 2**63, int(share * n) + n // 40).astype(np.uint64)]))
            if not len(b):
                continue
            may = ngram_join.may_link(ngram_join.sketch(a), len(a), ngram_join.sketch(b), len(b), 85)
            assert may or not ngram_join.links(a, b, 85)
            ruled += not may
    assert ruled >= 3


def test_parts_are_compared_exactly():
    import numpy as np

    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**63, 60).astype(np.uint64)
    sets = []
    for n in range(30):
        t = base.copy()
        t[rnd.integers(0, 60, rnd.integers(0, 8))] = rnd.integers(0, 2**63)
        sets.append((bytes([n]), np.unique(t)))
    left, right = sets[:12], sets[12:]
    union = np.unique(np.concatenate([t for _, t in right]))
    want = {frozenset((a, b)) for a, x in left for b, y in right if ngram_join.links(x, y, 85)}
    for most in (1, 50, 1 << 22):
        got = ngram_join.part_links(left, right, union, 85, most)
        assert {frozenset(p) for p in got} <= want and len(got) <= len(sets) - 1

        def blocks(pairs):
            root = {bytes([n]): bytes([n]) for n in range(30)}
            for p in pairs:
                a, b = tuple(p)
                a, b = root[a], root[b]
                root = {k: (a if v == b else v) for k, v in root.items()}
            return {frozenset(k for k in root if root[k] == v) for v in root.values()}

        assert blocks(got) == blocks(want)


def test_empty(spark):
    assert ngram_join.join_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert ngram_join.join_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].component_id == 1


def test_one_of_each_group_stays(spark):
    rows = corpus(7)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int")
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()]
    groups = {}
    for (d, t), root in zip(rows, roots(rows, 5, 80)):
        if shingles(t, 5):
            groups.setdefault(root, set()).add((d is None, d or 0, t))
    got = sorted((d is None, d or 0, t) for d, t in kept if shingles(t, 5))
    assert len(got) == len(groups)
    for g in groups.values():
        (own,) = [x for x in got if x in g]
        assert own[:2] == min(g)[:2]
    assert len([d for d, t in kept if not shingles(t, 5)]) == 3


def test_long_paths(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r.node, r.label) for r in components(links).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_n_links_counts_every_link_of_a_family(spark):
    rnd = random.Random(11)
    rows = []
    for family in range(3):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        for k in range(12):
            words = list(base)
            for _ in range(rnd.randrange(0, 4)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            rows.append((100 * family + k, " ".join(words)))
        rows.append((100 * family + 50, rows[-1][1]))  # an equal set is no other set
    sets = {d: frozenset(tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)) for d, t in rows}
    want = {d: sum(100 * len(s & o) >= 85 * len(s | o) for o in set(sets.values()) if o != s) for d, s in sets.items()}
    assert max(want.values()) > 4
    got = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()
    assert {r.doc_id: r.n_links for r in got} == want
