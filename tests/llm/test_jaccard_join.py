import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import jaccard_join
from lattica.llm.jaccard_join import jaccard_components
from tests.llm.helpers import words_of


def brute(rows, width=3, num=90, den=100):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([4, 30, 60, 120]))] for _ in range(25)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(260):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.4:
            w += passage
        rows.append((1000 - i, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
    return rows + [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "x " * 5000), (9, "x " * 5001)]


def components(docs, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, **kw).collect()}


@pytest.mark.parametrize(("seed", "kw"), [(1, {}), (2, {"most_slots": 0}), (3, {"leaf": (16, 4000)}), (4, {"leaf": (4, 400), "width": 2, "num": 70})])
def test_components_match_brute_force(spark, seed, kw):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert components(docs, **kw) == brute(rows, kw.get("width", 3), kw.get("num", 90))


def test_large_cells_go_down_by_pivots_and_windows(spark, monkeypatch):
    """A chain of near copies larger than a leaf: rounds over tasks, windows and leaves all run."""
    r = random.Random(7)
    rows, turns, cells = [], [], []
    w = [f"w{i}" for i in range(80)]
    for i in range(300):  # far ends of the chain are not linked with each other
        w[r.randrange(80)] = f"n{r.randrange(300)}"
        rows.append((i, " ".join(w)))
    real = jaccard_join._meet_pivots

    def spy(members, num, den, turn):
        turns.append(turn)
        made = real(members, num, den, turn)
        cells.append(made.where("cell IS NOT NULL").groupBy("region").agg(F.countDistinct("cell").alias("cells"), F.count("key").alias("rows"), F.countDistinct("key").alias("keys")).collect())
        return made

    monkeypatch.setattr(jaccard_join, "_meet_pivots", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert components(docs, leaf=(24, 10**6)) == brute(rows)
    assert turns and any(x.cells > 1 and x.rows > x.keys for x in cells[0])


def test_regions_keep_every_near_pair():
    r = np.random.default_rng(3)
    for _ in range(50):
        points = r.random((60, 2)) * r.choice([0.3, 2])
        eps = 0.1
        d = np.sqrt(((points[:, None] - points[None, :]) ** 2).sum(2))
        pivots = r.choice(60, 5, replace=False)
        part = jaccard_join._parts(60, *[np.concatenate(x) for x in zip(*[(np.flatnonzero(d[:, p] <= eps), np.full((d[:, p] <= eps).sum(), p)) for p in pivots], *[(x[i], x[j]) for x in jaccard_join.regions(d[:, pivots], d[:, pivots] <= eps, eps) for i, j in [np.nonzero(d[np.ix_(x, x)] <= eps)]], strict=True)])
        assert np.array_equal(part, jaccard_join._parts(60, *np.nonzero(d <= eps)))


def test_sets_linked_in_one_task():
    r = random.Random(5)
    for size in (2, 3, 9, 40):
        sets = []
        for _ in range(size):
            s = set(r.choice(sets)) if sets and r.random() < 0.8 else {r.getrandbits(60) for _ in range(40)}
            for x in r.sample(sorted(s), r.choice([0, 1, 2])):
                s.discard(x)
                s.add(r.getrandbits(60))
            sets.append(s)
        near = [(i, j) for i in range(size) for j in range(size) if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])]
        want = jaccard_join._parts(size, *np.array(near).T)
        assert np.array_equal(jaccard_join.link_region([np.array(sorted(s), np.uint64) for s in sets], 90, 100), want)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key string, n string, window string")
    assert jaccard_components(empty).count() == 0
    docs = spark.createDataFrame([(2, "a b c d", "k", "n"), (1, "a b c d", "k", "n")], "doc_id long, text string, key string, component_id string")
    assert {(r.doc_id, r.component_id) for r in jaccard_components(docs).collect()} == {(1, 1), (2, 1)}


def test_one_row_of_each_group_stays(spark):
    from lattica.llm.jaccard_join import one_of_each_component

    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z "
    rows = [(5, long, "x"), (3, long + "end", "x"), (3, long + "end", "y"), (9, "other words stand here alone", "x"), (9, "other words stand here alone", "x"), (7, None, "x"), (None, "no id", "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = one_of_each_component(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 3, 7, 8, 9]
    assert one_of_each_component(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_go_only_if_linked(spark):
    from lattica.llm.jaccard_join import one_of_each_component

    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(2, a, "kept"), (5, a + " end", "gone"), (5, b, "kept"), (7, b + " end", "gone"), (7, c, "kept"), (7, c + " end", "gone"), (8, "", "kept"), (8, None, "kept"), (None, a, "kept"), (6, "a text of its own", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = one_of_each_component(docs).collect()
    # of two linked rows with one id either may stay
    assert sorted((str(r.doc_id), str(r.text).removesuffix(" end")) for r in got) == sorted((str(i), str(t)) for i, t, x in rows if x == "kept")
