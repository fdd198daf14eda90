import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quern.llm import neardup, similar
from quern.llm.quantiser import Quantiser


def jaccard(a, b, n):
    x, y = ({tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def corpus(seed=1):
    r = random.Random(seed)
    text = lambda n: [f"w{r.randint(0, 3000)}" for _ in range(n)]
    out = []
    for _ in range(60):
        base = text(r.randint(60, 150))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            v = list(base)
            for _ in range(r.randint(0, 12)):
                v[r.randrange(len(v))] = f"x{r.randint(0, 99)}"
            out.append(" ".join(v))
    return out + [out[0]] * 20 + ["", "short text"]


def near(spark, texts, **k):
    df = spark.createDataFrame([(i * 3 + 1, t, "id clash") for i, t in enumerate(texts)] + [(1, texts[0], "again"), (None, "x", ""), (7000, None, "")], "rid long, body string, id string")
    other = spark.createDataFrame([(5, texts[0])], "rid long, body string")
    return neardup.NearDuplicates([(df, "t", "rid", "body"), (other, "o", "rid", "body")], **k)


def test_pairs_and_groups_against_brute_force(spark):
    texts = corpus()
    n = near(spark, texts, words=3, threshold=0.6, least=50)
    got = {tuple(r) for r in n.pairs().collect()}
    ids = [(i * 3 + 1, t) for i, t in enumerate(texts) if len(t.split()) >= 50]
    want = {("t", a, b) for (a, x), (b, y) in combinations(ids, 2) if jaccard(x, y, 3) >= 0.6}
    assert got <= want and len(got) >= 0.98 * len(want)
    g = {(r.item_table, r.id): r.group_id for r in n.groups().collect()}
    assert set(g) == {("t", i) for i, _ in ids} | {("o", 5)}
    parent = {i: i for i, _ in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in got:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(g["t", i] == find(i) for i, _ in ids)


def lanes(n, seed=2):
    return np.random.default_rng(seed).integers(0, 256, (n, neardup.LANES), dtype=np.uint8)


def signed(spark, x):
    return spark.createDataFrame([(0, i, bytearray(v.tobytes())) for i, v in enumerate(x)], "tab int, id long, sig binary")


def planted(n, pairs, agree, seed=3):
    """Signatures of which 2i and 2i + 1 agree in that share of lanes."""
    r, x = np.random.default_rng(seed), lanes(n)
    for i in range(pairs):
        same = r.random(neardup.LANES) < agree
        x[2 * i + 1, same] = x[2 * i, same]
    return x


def test_the_prefix_is_shortened_as_far_as_the_collection_needs():
    close, far = {120: 500}, {120: 500, 80: 40}
    ks = [neardup.shortened(c, 0.6) for c in (close, far, {})]
    assert ks[0] == neardup.DEPTH > ks[1] >= ks[2] > 1
    assert neardup.met(np.array([0.6]), ks[2])[0] >= neardup.TARGET > neardup.met(np.array([0.6]), ks[2] + 1)[0]


def test_recall_at_and_above_the_threshold(spark):
    for agree in (0.68, 0.97):
        got = {(r.a, r.b) for r in neardup.candidates(signed(spark, planted(4000, 400, agree)), 0.6).collect()}
        assert sum((2 * i, 2 * i + 1) in got for i in range(400)) >= 0.98 * 400


def test_a_crowded_node_loses_nothing_and_emits_only_likely_pairs(spark):
    counts = []
    for n in (6000, 24000):  # all below one node of one tree; no other labels in common
        x = planted(n, n // 40, 0.8)
        x[:, :8] = 7
        x[: n // 20 : 2, 8:][:, ::16] ^= 1
        got = {(r.a, r.b) for r in neardup.candidates(signed(spark, x), 0.6).collect()}
        assert sum((2 * i, 2 * i + 1) in got for i in range(n // 40)) >= 0.99 * (n // 40)
        counts.append(len(got))
    assert counts[1] <= 6 * counts[0] and counts[1] < 2 * 24000


def test_every_match_of_a_whole_string_counts_for_the_prefix(spark, monkeypatch):
    x = planted(1400, 300, 0.9)
    x[:, :8] = 7  # a crowd below one node
    want, least = {}, neardup.LANES * neardup.at_threshold(0.6)
    for t in range(neardup.TREES):
        s = x[:, (4 * t + np.arange(neardup.DEPTH)) % neardup.LANES]
        for i in range(len(x)):
            for j in i + 1 + np.flatnonzero((s[i + 1 :] == s[i]).all(axis=1)):
                n = int((x[i] == x[j]).sum())
                if n >= least:
                    want[n] = want.get(n, 0) + 1
    given, right = [], neardup.shortened
    monkeypatch.setattr(neardup, "shortened", lambda seen, *k: given.append(seen) or right(seen, *k))
    neardup.candidates(signed(spark, x), 0.6).count()
    assert {n: c for n, c in given[0].items() if n >= least} == want


def test_large_nodes_are_counted_whole(spark):
    keys = spark.range(3 * neardup.HOT - 1).selectExpr(f"id div {neardup.HOT} as key", "id")
    assert sorted(map(tuple, neardup.hot_nodes(keys).collect())) == [(i, neardup.HOT // neardup.BLOCK) for i in (0, 1)]


def test_walking_and_blocks(spark):
    ids = list(range(10, 10 + 57))
    keys = spark.createDataFrame([(1, i) for i in ids] + [(2, 1), (3, 5), (3, 4)], "key long, id long")
    walked = neardup.walk_trees(keys, crowd=8)
    assert {(r.a, r.b) for r in walked.where("b is not null").collect()} == {(4, 5)}
    members = walked.where("b is null").select("key", "a", (F.col("a") % 3).cast("int").alias("block"), F.lit(2).alias("last"))
    sig = spark.createDataFrame([(i, bytearray(neardup.LANES)) for i in ids], "id long, sig binary")
    assert sorted(map(tuple, neardup.crowded_pairs(members, sig, 0.6).collect())) == sorted(combinations(ids, 2))


def test_repeated_ids_with_different_texts_count_by_one_of_them(spark):
    long = [" ".join(f"{w}{i}" for i in range(80)) for w in "ab"]
    rows = [(1, long[0]), (1, long[1]), (2, long[0]), (3, long[1]), (1, "short")]
    got = [set(map(tuple, neardup.NearDuplicates([(spark.createDataFrame(x, "rid long, body string"), "t", "rid", "body")], words=3, threshold=0.6).pairs().collect())) for x in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0] & {("t", 1, 2), ("t", 1, 3)}) == 1


def test_nothing_in_nothing_out(spark):
    df = spark.createDataFrame([], "rid long, body string")
    n = neardup.NearDuplicates([(df, "t", "rid", "body")])
    assert n.pairs().count() == 0 and n.groups().count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    e = [("t", i, i + 1) for i in range(40)] + [("t", 100, i) for i in range(101, 160)] + [("u", 1, 2)]
    got = {(r.item_table, r.u): r.root for r in neardup.components(spark.createDataFrame(e, "item_table string, u long, v long")).collect()}
    assert all(got["t", i] == 0 for i in range(1, 41)) and all(got["t", i] == 100 for i in range(101, 160)) and got["u", 2] == 1


# ---- vectors


def clustered(n, dim, seed=0):
    r = np.random.default_rng(seed)
    c = r.normal(size=(max(1, n // 12), dim))
    return (c[r.integers(0, len(c), n)] + 0.45 * r.normal(size=(n, dim))).astype(np.float32)


def test_encoding_is_better_with_a_beam():
    x = clustered(1500, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = Quantiser.train(x, 32, 3)
    err = [((x - q.decode(q.encode(x, beam=b))) ** 2).sum(1).mean() for b in (1, 8)]
    assert err[1] < err[0] < 0.8


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i])[:k]}


def test_recall_in_parts_and_blocks(spark):
    x = clustered(1200, 32)
    df = spark.createDataFrame([(i, [float(y) for y in v], "c") for i, v in enumerate(x)], "chunk_id long, e array<float>, cell string")
    want = brute(x, 5)
    for part in (8192, 100, 20):  # one part; parts of cells; cells of several blocks
        n = similar.Neighbours(df, "chunk_id", "e", 32, 5, part=part)
        got = {(r.chunk_id, r.neighbour) for r in n.lists().collect()}
        assert len(got) == 6000 and len(got & want) / len(want) >= 0.9


def test_dirty_vectors_copies_and_conflicts(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.01 * i]) for i in range(4)] + [(10 + i, [0.0, 1.0]) for i in range(9)] + [(1, [1.0, 0.01]), (50, None), (51, [0.0, 0.0]), (52, [nan, 1.0]), (53, [1.0]), (None, [1.0, 0.0]), (54, [1.0, None]), (2, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "chunk_id long, e array<double>")
    n = similar.Neighbours(df, "chunk_id", "e", 2, 5)
    got = {}
    for r in n.lists().collect():
        got.setdefault(r.chunk_id, []).append(r.neighbour)
    assert set(got) == {0, 1, 2, 3, *range(10, 19)} and all(len(set(v)) == 5 for v in got.values())
    assert set(got[12]) == {10, 11, 13, 14, 15} and all(k not in v for k, v in got.items())
    p = n.pairs()
    assert p.where(F.col("chunk_id_a") >= F.col("chunk_id_b")).count() == 0 and p.count() == p.distinct().count()


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "chunk_id long, e array<float>")
    assert similar.Neighbours(df, "chunk_id", "e", 2, 5).pairs().count() == 0
    assert similar.Neighbours(df.limit(0), "chunk_id", "e", 2, 5).pairs().count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, e array<float>")
    assert similar.Neighbours(one, "chunk_id", "e", 2, 5).pairs().count() == 0


def test_large_clusters_lie_in_many_cells_and_lose_nothing(spark):
    r = np.random.default_rng(4)
    x = (r.normal(size=(6, 96))[r.integers(0, 6, 6000)] + 1.2 * r.normal(size=(6000, 96))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, e array<float>")
    want = brute(x, 5)
    for part in (8192, 500):
        got = {(r.chunk_id, r.neighbour) for r in similar.Neighbours(df, "chunk_id", "e", 96, 5, part=part).lists().collect()}
        assert len(got) == 30000 and len(got & want) / len(want) >= 0.99


def test_a_pair_counts_for_the_side_that_does_not_probe():
    x = np.array([[1, 0], [0.8, 0.6], [0.6, 0.8]], dtype=np.float32)
    part, lists = similar.Part(np.array([7, 5, 3]), np.array([0, 0, 1]), x, 1), similar.Lists(1, 1)
    assert part.at == {0: (0, 2), 1: (2, 3)} and part.h.tolist() == [5, 7, 3]
    for _ in range(2):  # a second delivery changes nothing
        part.compare(np.array([[0.96, 0.28]], dtype=np.float32), np.array([9]), lists, np.array([0]), np.array([0]), True)
    assert lists.h[0, 0] == 7 and part.lists.h[:2, 0].tolist() == [9, 9] and not np.isfinite(part.lists.e[2]).any()


def test_ties_and_packing():
    i, j = similar.top(np.array([[1, 2, 2, 2], [0, -np.inf, 3, 1]], dtype=np.float32), 2)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (1, 2), (1, 3)]
    x = clustered(20, 24)
    assert (similar.unpacked(similar.packed(x), 24) == x).all()
