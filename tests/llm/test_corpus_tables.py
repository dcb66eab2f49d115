"""Collocations, token counts and the Merkle manifest."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
import sentencepiece
from pyspark.sql import functions as F

from textloom.llm import collocations, merkle, queries, token_counts
from textloom.llm.common import fold

from ..oracle import same


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# Collocations


def plain_phrases(docs, max_n, least, share, top):
    """(lang, rank, phrase, a, l, r, n, score) by fractions, and every longer candidate looked at."""
    counts, words = {}, Counter()
    for text, lang in docs:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            score, k = min((Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]]).__floor__(), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, words[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("max_n", [2, 3, 5])
def test_phrases_equal_a_plain_count(spark, max_n):
    pieces = ["New York City is big", "the new york city hall", "a a a a a", "a\ta  a", "É É ß 🙂 é", "one two three", "x. y, x; y: x! y? x\ny\x0bx\x0cy\rx", ""]
    docs = [(". ".join(pieces[(i * k) % len(pieces)] for k in range(9)), ["en", None, "und", "de"][i % 4]) for i in range(60)] + [(None, "en"), ("", "fr"), ("...", "fr")]
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    for least, share, top in ((1, 50, 2000), (10, 50, 4), (3, 101, 2000)):
        assert rows_of(collocations.mine(frame, max_n, least, share, top)) == plain_phrases(docs, max_n, least, share, top)


def test_scores_beyond_64_bits(spark):
    counts = spark.range(1).select(*[F.lit(n).alias(c) for n, c in ((10**12, "f"), (10**12 + 7, "l"), (3 * 10**12 + 1, "r"))])
    assert counts.select(collocations._score(F.col("f"), F.col("l"), F.col("r"))).first()[0] == 10**6 * 10**24 // ((10**12 + 7) * (3 * 10**12 + 1))


def test_phrases_of_parts_add_up(monkeypatch):
    texts = [b"a b c. a b", b"a b c d e f g h " * 50, b"", b"z"]
    whole = Counter({(x, p): n for names, phrases, ns in collocations.counted(texts, ["l", "m", "l", "l"]) for x, p, n in zip(names.to_pylist(), phrases.to_pylist(), ns.tolist())})
    apart = Counter()
    for t, x in zip(texts, ["l", "m", "l", "l"]):
        for names, phrases, ns in collocations.counted([t], [x]):
            for a, p, n in zip(names.to_pylist(), phrases.to_pylist(), ns.tolist()):
                apart[a, p] += n
    assert whole == apart and whole["l", b"a b"] == 2 and whole["m", b"h a"] == 49


def test_a_full_filter_lets_all_through(spark, monkeypatch):
    docs = [(" ".join("abcdefghijklmnopqrstuvw"[(i * k) % 23] for k in range(40)), "en") for i in range(40)]
    monkeypatch.setattr(collocations, "BITS", 64)
    assert rows_of(collocations.mine(spark.createDataFrame(docs, "text string, lang string"), 4, 3)) == plain_phrases(docs, 4, 3, 50, 2000)


def test_phrase_frames(spark, sf, messy, empty):
    assert collocations.mine(empty).count() == 0
    got = rows_of(collocations.mine(messy, least=2))
    assert got == plain_phrases([(r["text"], r["lang"]) for r in messy.collect()], 3, 2, 50, 2000)
    same(queries.op11_collocations(spark, sf), collocations.ORACLE, sf)


# Token counts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)


def test_counts_equal_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_token_counts(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {tuple(r) for r in got.collect()} == {(i, len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}


def test_counts_of_messy_rows(spark, messy, empty, library):
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in messy.collect())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count(messy).collect()) == want
    assert token_counts.count(empty).count() == 0


@pytest.mark.parametrize("broadcast", [0, 1 << 18])
def test_cache_is_used_and_kept(spark, tmp_path, monkeypatch, library, broadcast):
    monkeypatch.setattr(token_counts, "BROADCAST", broadcast)
    cache = f"file://{tmp_path}/counts"
    docs = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    first = docs("a b", "a▁b", None, "", "copy", *["copy"] * 50)
    assert token_counts.fill(first, cache) == 3  # a sign that is written like a space is one
    assert token_counts.fill(first, cache) == 0
    assert token_counts.fill(docs("copy", "new", "new"), cache) == 1
    assert spark.read.parquet(cache).count() == 4
    token_counts.cached(spark, cache).select(F.col("content"), (F.col("n_tokens") + 1000).alias("n_tokens"), F.lit(token_counts.version()).alias("version")).write.partitionBy("version").mode("append").parquet(cache)
    got = token_counts.count(docs("copy", "never seen"), cache).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [1000 + len(library.encode("copy")), len(library.encode("never seen"))]  # from the cache; equal digests are one row


def test_another_version_finds_nothing(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/counts"
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert token_counts.fill(docs, cache) == 1
    monkeypatch.setattr(token_counts.sentencepiece, "__version__", "0.0")
    assert token_counts.fill(docs, cache) == 1
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


# Merkle manifest


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def plain_tree(leaves, fanout=2):
    """The root, and for each leaf its ways up: the run's nodes and the place in it, level by level."""
    ways, places, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for way, at in zip(ways, places):
            way.append((nodes[at - at % fanout : at - at % fanout + fanout], at % fanout))
        places = [at // fanout for at in places]
        nodes = [h(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]
    return nodes[0], ways


def plain_leaf(values):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return hashlib.sha256("".join(map(text, values)).encode()).hexdigest()


def plain_proofs(docs, fanout=2):
    """docs: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for d in docs:
        groups.setdefault("" if d[2] is None else "=" + d[2], []).append((d[0] is not None, d[0] or 0, plain_leaf(d), d))
    names, out = sorted(groups, key=str.encode), []
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    root, above = plain_tree([trees[g][0] for g in names], fanout)
    for g, over in zip(names, above):
        for (_, _, leaf, d), way in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            way = way + over
            claimed = leaf
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[3] is not None:
                claimed = plain_leaf((*d[:3], d[3] + 1, d[4]))
            proof = h(*[x for run, at in way for i, x in enumerate(run) if i != at])
            for run, at in way:
                claimed = h(*[claimed if i == at else x for i, x in enumerate(run)])
            out.append((d[0], leaf, trees[g][0], root, proof, claimed, claimed == root))
    return sorted(out, key=str)


def proved(docs, fanout=2):
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = merkle.leaf(*[more if c == "n_chars" else F.col(c) for c in merkle.COLUMNS])
    return merkle.proofs(merkle.manifest(docs, claimed=F.when((fold("doc_id", 7) == 0) & more.isNotNull(), changed), fanout=fanout))


@pytest.mark.parametrize(("fanout", "sizes", "block", "merge"), [(2, (1, 2, 3, 37), 2, 2), (2, (700,), 8, 32), (3, (0, 29, 1, 27), 1, 2), (5, (126, 5, 4), 8, 3)])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, fanout, sizes, block, merge):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "MERGE", merge)
    langs = [None, "", "en", "é"]
    rows = [(k * 1000 + i if i % 11 else None, f"s{i % 3}", langs[k], i if i % 5 else None, f"text {i % 7}") for k, n in enumerate(sizes) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
        assert rows_of(proved(docs, fanout)) == plain_proofs(rows, fanout)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_of_any_cut_make_the_whole_tree():
    for n in (1, 2, 5, 17, 64, 65):
        for cuts in ([0, n], [0, n // 2, n], [0, 1, n // 3, n // 3, n - 1, n], list(range(n + 1))):
            for fanout in (2, 3):
                leaves, nodes, edges = [hashlib.sha256(str(i).encode()).digest() for i in range(n)], {}, []
                for a, b in zip(cuts, cuts[1:]):
                    peaks = merkle.Range(n, fanout, lambda level, at, digest: nodes.__setitem__((level, at), digest))
                    for at in range(a, b):
                        peaks.push(at, leaves[at])
                    edges += peaks.close()
                made, left = merkle.merged(edges, n, fanout)
                nodes |= {(level, at): digest for level, at, digest in made}
                top = max(nodes, default=(0, 0))
                assert not left and (nodes.get(top, leaves[0])).hex() == plain_tree([x.hex() for x in leaves], fanout)[0]


def test_manifest_frames(spark, sf, messy, empty):
    keyed = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in messy.collect()]
    assert rows_of(proved(messy)) == plain_proofs(keyed)
    assert proved(empty).count() == 0 and merkle.manifest(empty).root is None
    same(queries.op13_merkle(spark, sf), merkle.ORACLE, sf)
