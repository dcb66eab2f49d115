import random
from collections import Counter

import numpy as np

from textloom.llm import probminhash as M
from textloom.llm.components import components


def plain_probability(a, b):
    """By the definition, in the order of the squares."""
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(w, 0) / a[z], b.get(w, 0) / b[z]) for w in every) for z in a.keys() & b.keys())


def plain_counts(text):
    w = text.encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_similar(a, b):
    if not a or not b or len(a.keys() & b.keys()) >= 0.8 * len(a.keys() | b.keys()):
        return bool(a and b)
    return max(*a.values(), *b.values()) > 1 and plain_probability(a, b) >= 0.8 - 1e-12


def plain_classes(rows):
    sets = [plain_counts(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or plain_similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def test_classes_equal_brute_force(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    rows, passage = [], [word() for _ in range(60)]
    for i in range(12):
        base = [word() for _ in range(draw.randint(3, 150))]
        for _ in range(draw.randint(1, 12)):
            copy = [word() if draw.random() < 0.012 else w for w in base]
            rows.append(" ".join(copy))
    rows += [" ".join([word() for _ in range(30)] + passage) for _ in range(25)] + ["", "", " ", None, None, "one two"]
    rows = list(enumerate(rows))
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.classes(docs).toPandas()
    want = plain_classes(sorted(rows))
    sure = {k: v for k, v in want.items()}
    assert dict(zip(got["doc_id"], got["class_id"])) == sure
    assert got[got["kept"]].groupby("class_id").size().max() == 1
    assert M.deduplicate(docs).count() == len(set(want.values()))


def test_tiles_of_a_bucket_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    words = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(words[:95] + [f"x{i}", f"y{i}"])) for i in range(40)]
    got = M.classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got["class_id"]) == {0}


def test_repeated_shingles_count_by_weight_and_by_set(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    single, block = [word() for _ in range(400)], [word() for _ in range(100)]
    rows = [(0, single + block), (1, single + block * 10)]  # the same set, a probability Jaccard of about a half
    rows += [(2 + k, [word() for _ in range(150)] + block[:60] * 40) for k in range(2)]  # other words, but the weight in common
    rows += [(10 + k, [word() for _ in range(300)] + block[:60] * 2) for k in range(2)]  # neither
    rows = [(i, " ".join(x)) for i, x in rows]
    sets = dict(zip((i for i, _ in rows), M.counted([t.encode() for _, t in rows], M.Words())))
    for i, a in rows:
        for j, b in rows:
            assert abs(M.probability_jaccard(*sets[i], *sets[j]) - plain_probability(plain_counts(a), plain_counts(b))) < 1e-9
    assert M.probability_jaccard(*sets[0], *sets[1]) < 0.6 < 0.8 < M.set_jaccard(sets[0][0], sets[1][0])
    assert M.probability_jaccard(*sets[2], *sets[3]) > 0.8 > 0.5 > M.set_jaccard(sets[2][0], sets[3][0])
    got = {r["doc_id"]: r["class_id"] for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 10: 10, 11: 11}


def test_recall_of_near_copies_against_brute_force(spark):
    """Pairs of similarity 0.8 to 0.9, far from a pivot: alone in their buckets or in those of a passage that many share."""
    draw = random.Random(13)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    passage, rows = [word() for _ in range(120)], []
    for k in range(300):
        words = [word() for _ in range(120)] + (passage if k % 2 else [word() for _ in range(120)])
        near = list(words)
        for at in draw.sample(range(10, 110), 4):
            near[at] = word()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    got = {r["doc_id"]: r["class_id"] for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(a, b) for (a, s), (b, t) in zip(rows[::2], rows[1::2]) if plain_similar(plain_counts(s), plain_counts(t))]
    assert len(pairs) > 250 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(got[a] >= a - 1 for a in got)  # and nothing else


def test_large_open_buckets_are_cut_by_finer_bands(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    draw = random.Random(14)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    passage, rows = [word() for _ in range(300)], []
    for k in range(80):
        words = passage + [word() for _ in range(100)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], word()]))]
    got = {r["doc_id"]: r["class_id"] for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_classes(rows)
    assert sum(got[i] == want[i] for i in got) >= 158 and all(got[i] >= want[i] for i in got)


def test_joining_links_what_is_similar_and_apart():
    ones = lambda x: (x.astype(np.uint64), np.ones(len(x), np.int64))
    sets = [ones(x) for x in (np.arange(10), np.arange(1, 11), np.arange(50, 60), np.arange(50, 60), np.arange(0))]
    assert M.joining(sets, list("abcde")) == [(0, 1), (2, 3)]
    assert M.joining(sets, list("aaccd")) == []
    heavy = [(np.array([1, 2, 9], np.uint64), np.array([1, 1, 90])), (np.array([3, 4, 9], np.uint64), np.array([1, 1, 90]))]
    assert M.joining(heavy, list("ab")) == [(0, 1)]


def test_signatures_estimate_probability_jaccard():
    draw = np.random.default_rng(5)
    for scale in (1, 3):
        x, y = np.arange(1, 401, dtype=np.uint64), np.arange(101, 501, dtype=np.uint64)
        a, b = draw.integers(1, 9, 400), draw.integers(1, 9, 400) * scale
        s = M.signatures([(M.mixed(x), a), (M.mixed(y), b)], slots=4096)
        of = lambda e, w: dict(zip(e.tolist(), w.tolist()))
        want = plain_probability(of(x, a), of(y, b))
        assert abs(M.probability_jaccard(x, a, y, b) - want) < 1e-9
        assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_messy_rows(messy, empty):
    got = M.classes(messy).collect()
    assert len(got) == messy.count()
    assert {r["class_id"] for r in got if r["doc_id"] == 6} == {6} and sum(r["kept"] for r in got if r["doc_id"] == 6) == 1
    out = M.deduplicate(messy)
    assert out.columns == messy.columns and out.where("text IS NULL").count() == 2 and out.where("doc_id = 6").count() == 1
    assert M.classes(empty).count() == 0 and M.deduplicate(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}
