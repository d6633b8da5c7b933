import numpy as np
import pytest

from inkfold.llm.components import connected_components
from inkfold.llm.embedding_dedup import near_vectors
from inkfold.llm.minhash_dedup import MAX_DISTANCE, SYMBOLS, index_entries, near_texts, shingle_sets


def union_find(pairs):
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("block", [2048, 8])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    rows = [base, base[:20] + 0.12 * rng.standard_normal((20, 64)), base[:1] + 0.02 * rng.standard_normal((40, 64)), base[5:9] * 3, base[30:33]]
    x = np.concatenate(rows).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] + [1.0] * 63), (904, [1.0, 2.0]), (905, [float("inf")] + [0.0] * 63), (None, data[0][1])]
    df = spark.createDataFrame([(*d, "extra", 1) for d in data], "vec_id long, embedding array<float>, rep string, copies int")
    got = {r.vec_id: r for r in near_vectors(df, block=block).collect()}
    assert len(got) == len(data)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    component = union_find([(i, j) for i, j in zip(*np.nonzero(links), strict=True)] + [(i, i) for i in range(len(x))])
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= links.sum() and found >= 0.99 * links.sum()
    for i in range(len(x)):
        assert got[i].component_id == component[i] and got[i].kept == (component[i] == i)
    for i in range(900, 906):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert near_vectors(df.limit(0)).collect() == []


def test_vectors_of_other_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((2, 128))
    z = [1.0, 2.0]
    data = [(3, x), (5, x), (5, y), (8, y), (9, y[:64]), (12, x[:64]), (11, x[:64] * 4), (20, z), (21, [2.0, 4.0]), (22, [-1.0, 2.0]), (7, None), (7, x + 0.001 * y), (30, [5.0]), (31, [7.0]), (32, []), (1, z + [0.0])]
    df = spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in data], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert got == [
        (1, 0, 1, True), (3, 2, 3, True), (5, 1, 3, False), (5, 2, 3, False), (7, 0, 7, True), (7, 2, 3, False), (8, 1, 3, False), (9, 0, 9, True), (11, 1, 11, True), (12, 1, 11, False),
        (20, 1, 20, True), (21, 1, 20, False), (22, 0, 22, True), (30, 1, 30, True), (31, 1, 30, False), (32, 0, 32, True),
    ]


def test_plan_grows_with_the_table():
    from inkfold.llm.embedding_dedup import CHANCE, meeting, plan

    seen = [plan(n, 0.95, 1.2, 0.998) for n in (1, 1000, 100_000, 10**7, 10**9)]
    assert seen == sorted(seen) and seen[0][0] == 4
    for n, (bits, tables) in zip((10**5, 10**9), seen[2::2], strict=True):
        assert n * meeting(2**0.5, 1.2) ** bits <= CHANCE and 1 - (1 - meeting(0.1**0.5, 1.2) ** bits) ** tables >= 0.998


def test_index_meets_every_pair_within_the_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, (300, SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(SYMBOLS, MAX_DISTANCE, replace=False)
        row[at] ^= np.uint16(1)
    assert (index_entries(a) == index_entries(b)).any(axis=1).all()
    assert not (index_entries(a) == index_entries(a[::-1])).any(axis=1).any()


def exact_sets(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_sets():
    texts = ["a b c d e", "A B c\td", "one two", "", None, "  ", "x " * 50, "é É a b c", "w" * 5000 + " a b c d", "W" * 5000 + " a b c d", "\u00a0 a b c d"]
    for n in (4, 5):
        assert [len(s) for s in shingle_sets(texts, n)] == [len(exact_sets(t, n)) for t in texts]
    s = list(shingle_sets(texts, 4))
    assert (s[8] == s[9]).all() and s[0].tolist()[0] in s[0]


@pytest.mark.parametrize("words", [4, 5])
def test_texts_against_brute_force(spark, words):
    rng = np.random.default_rng(words)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, rng.integers(3, 120))) for _ in range(60)]
    texts = list(base)
    for t in base[:25]:  # near copies of every degree
        w = t.split()
        for at in rng.integers(0, len(w), rng.integers(1, 6)):
            w[at] = "changed"
        texts.append(" ".join(w))
    big = " ".join(rng.choice(vocabulary, 100))
    for _ in range(60):  # one group whose members lie around the threshold
        w = big.split()
        for at in rng.integers(0, 100, rng.integers(0, 5)):
            w[at] = f"n{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    texts += base[:3] + [base[0].upper(), "", None, "  \n", "one", "ONE", "two words", base[4]]
    data = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, "x", 2) for d in data] + [(None, base[0], "x", 2)], "doc_id long, text string, rep string, entry int")
    got = {r.doc_id: r for r in near_texts(df, shingle_words=words).where("doc_id is not null").collect()}
    sets = {i: exact_sets(t, words) for i, t in data}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find([*pairs, *((i, i) for i in sets)])
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    assert near_texts(df.limit(0)).collect() == []


def test_hot_entries_and_small_blocks(spark, monkeypatch):
    from inkfold.llm import minhash_dedup as M

    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "SAMPLE", 4)
    monkeypatch.setattr(M, "SET_BLOCK", 8)
    test_texts_against_brute_force(spark, 4)


def by_brute_force(data, words, percent=80):
    """Component of each (id, text): ids are the vertices."""
    sets = [(i, exact_sets(t, words)) for i, t in data]
    pairs = [(i, i) for i, s in sets if s]
    pairs += [(i, j) for i, a in sets for j, b in sets if a and b and 100 * len(a & b) >= percent * len(a | b)]
    return union_find(pairs)


def test_repeated_ids(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(20)) for c in "xy")
    rng = np.random.default_rng(9)
    many = [" ".join(rng.permutation([f"m{i}" for i in range(30)])) for _ in range(12)]
    for data in (
        [(3, x), (5, x), (5, y), (8, y)],
        [(10, x), (10, y), (12, y + " more"), (4, x + " more")],
        [(9, x), (9, None), (9, ""), (9, x + " more"), (2, y)],
        [(int(rng.integers(0, 9)), many[rng.integers(0, 12)] + " end" * int(rng.integers(0, 2))) for _ in range(40)],
    ):
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        want = by_brute_force(data, 5)
        got = near_texts(df).collect()
        assert len(got) == len(data)
        for r in got:
            assert r.component_id == (want[r.doc_id] if r.n_shingles else r.doc_id) and r.kept == (r.component_id == r.doc_id)


def test_joins_beyond_the_broadcast_limit(spark, monkeypatch):
    from inkfold.llm import minhash_dedup as M
    from inkfold.plans import shared

    monkeypatch.setattr(M, "label_join", lambda *a, **k: shared.label_join(*a, **k, limit=3))
    monkeypatch.setattr(shared, "HOT_SHARE", 20)
    test_repeated_ids(spark)
    test_texts_against_brute_force(spark, 4)


def test_large_groups(spark, monkeypatch):
    """One component with most of an entry's members and some apart from it."""
    from inkfold.llm import minhash_dedup as M

    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "SET_BLOCK", 4)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(120):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4) if i % 3 else rng.integers(2, 6)):
            w[at] = f"n{rng.integers(0, 5)}"
        data.append((i, " ".join(w)))
    want = by_brute_force(data, 5)
    got = {r.doc_id: r.component_id for r in near_texts(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want and 3 < len(set(want.values())) < 100


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_texts(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    with pytest.raises(ValueError, match=r"0\.8"):
        near_texts(df, percent=70)
