"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text's elements are its five-word shingles (words between ASCII white space; a text of one to four words is one
shingle), weighted by their counts. Every element is a Poisson process whose rate is its weight: its arrivals, from
hashes of the element, fall on one of SLOTS slots each, and a slot's signature is the element that arrives first. Two
texts agree in a slot with the probability Jaccard similarity of their weights, at any scale of the weights. Arrivals
stop early: those after the time by which all slots are filled can't change anything. Signatures are banded (BANDS
bands of ROWS slots: similarity 0.8 shares a band with probability 0.9993, 0.85 with 0.99999).

Similar are texts whose probability Jaccard similarity is 0.8 or more, or whose plain Jaccard similarity of shingle
sets is. Without repeated shingles both are the same number. A text that repeats a shingle has a second signature with
all weights 1, whose bands join the same buckets, so both kinds of pairs have the probabilities above. Texts that share a
band are verified by both similarities, computed exactly.

Equal texts are one node (by their md5), so copies cost nothing after the first stage. Inside a band's bucket not all
pairs are compared: the smallest member is the pivot for all the others. Buckets that then still hold several
components are compared in tiles. One of more than BLOCK members is first cut into smaller ones by FINE further bands of
FINE_ROWS slots, each from other bands (a pair of similarity 0.8 is then lost with probability 0.00001); what is still too
large is cut into tiles of two blocks of about BLOCK members or ELEMENTS shingles. A tile's sets are compared at once by
the product of their shingle incidence matrices (columns that only one text has are dropped, so texts that share a
passage and no more cost little); it emits the links that join components, fewer than its members. So no row is made for
a pair, no task holds more than a tile, and a group's size has no cap. Keys that very many rows share (a bucket, a pivot,
a node of many copies, a component) are joined by key and salt.

Defined cases: null texts belong to no group (class of their own); empty texts are copies of each other, as are texts
of white space alone only if they are equal; null ids take part, and a class is named by its smallest non-null id.
Repeated rows are copies, one of which is kept. Extra columns, of any name, are ignored by `classes` and passed through by
`deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, for_each_salt, looked_up, materialise, parts, salt, salts_held, tidy, unused, with_least
from .components import components

WIDTH, SIMILARITY = 5, 0.8
ROWS, BANDS = 6, 24
SLOTS = ROWS * BANDS
MEMO = 400_000
BLOCK, COLUMNS, ELEMENTS = 1024, 4096, 1 << 20
FINE, FINE_ROWS = 28, 5

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


class Words(dict):
    """The hash of each word met so far."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes, memo: Words) -> np.ndarray:
    """Hashes of the text's shingles in order, repeats included."""
    words = text.split()
    n = len(words)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    if len(memo) > MEMO:
        memo.clear()
    if not n:
        return h
    width = min(WIDTH, n)
    out = h[: n - width + 1].copy()
    for k in range(1, width):
        out = out * _P + h[k : n - width + 1 + k]
    return mixed(out + _U(width))


def _first_arrivals(elements, weights, owner, n_docs: int, until: np.ndarray, slots: int):
    """For each slot of each document the element that arrives first before the document's `until`; 0 where none does."""
    best = np.full(n_docs * slots, np.inf)
    who = np.zeros(n_docs * slots, np.uint64)
    at = np.zeros(len(elements))
    step = 0
    while len(elements):
        step = (step + int(_P)) % (1 << 64)
        h = mixed(elements + _U(step))
        at = at - np.log(((h >> _U(32)).astype(np.float64) + 0.5) / 4294967296.0) / weights
        in_time = at <= until[owner]
        elements, weights, owner, at, h = elements[in_time], weights[in_time], owner[in_time], at[in_time], h[in_time]
        cell = owner * slots + (((h & _U(0xFFFFFFFF)) * _U(slots)) >> _U(32)).astype(np.int64)
        np.minimum.at(best, cell, at)
        first = at == best[cell]
        who[cell[first]] = elements[first]
    return who.reshape(n_docs, slots), np.isfinite(best).reshape(n_docs, slots).all(1)


def counted(texts: list[bytes], memo: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's different shingles, sorted, and their counts."""
    return [np.unique(shingles(t, memo), return_counts=True) for t in texts]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """A row of `slots` element hashes for each of the weighted sets, all 0 for empty ones."""
    out, todo, extra = np.zeros((len(sets), slots), np.uint64), [i for i, s in enumerate(sets) if len(s[0])], 3.0
    while todo:
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        until = slots * (np.log(slots) + extra) / np.bincount(owner, weights)
        got, full = _first_arrivals(elements, weights, owner, len(todo), until, slots)
        out[[i for i, f in zip(todo, full, strict=True) if f]] = got[full]
        todo, extra = [i for i, f in zip(todo, full, strict=True) if not f], extra + 12
    return out


def views(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """Each set, and again with weights of 1 where a shingle repeats; with the number of the set that it is a view of."""
    plain = [i for i, (_, n) in enumerate(sets) if len(n) and n.max() > 1]
    return [*range(len(sets)), *plain], [*sets, *((sets[i][0], np.ones(len(sets[i][0]), np.int64)) for i in plain)]


def _hashed(rows: np.ndarray) -> np.ndarray:
    """The last axis as one hash; the place along the one before it is part of the hash."""
    h = np.broadcast_to(np.arange(1, rows.shape[1] + 1, dtype=np.uint64) * _P, rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        h = mixed(h * _P + rows[:, :, k])
    return h.view(np.int64)


def bands(signature: np.ndarray) -> np.ndarray:
    """A row of BANDS hashes for each signature."""
    return _hashed(signature.reshape(len(signature), BANDS, ROWS))


def fine_bands(signature: np.ndarray) -> np.ndarray:
    """A row of FINE hashes, each of FINE_ROWS slots that lie in different bands."""
    return _hashed(signature[:, : FINE * FINE_ROWS].reshape(len(signature), FINE_ROWS, FINE).transpose(0, 2, 1))


def set_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets; 0 if one is empty."""
    if not len(x) or not len(y):
        return 0.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def probability_jaccard(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> float:
    """Of elements x with weights a and y with b: the sum over common z of 1 / sum over w of max(a[w] / a[z], b[w] / b[z])."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = a.astype(float), b.astype(float)
    only_a, only_b = a.sum() - a[i].sum(), b.sum() - b[j].sum()
    order = np.argsort(a[i] / b[j], kind="stable")
    p, q = a[i][order], b[j][order]
    ratio = p / q
    low = np.searchsorted(ratio, ratio)  # elements of a smaller ratio count by b, the others by a
    of_a, of_b = np.concatenate((np.cumsum(p[::-1])[::-1], [0])), np.concatenate(([0], np.cumsum(q)))
    return float((1 / ((of_a[low] + only_a) / p + (of_b[low] + only_b) / q)).sum())


def similar(one: tuple, other: tuple) -> bool:
    """Whether two weighted sets are similar by either measure."""
    (x, a), (y, b) = one, other
    if set_jaccard(x, y) >= SIMILARITY - 1e-12:
        return True
    repeats = len(x) and len(y) and max(a.max(), b.max()) > 1
    return bool(repeats) and probability_jaccard(x, a, y, b) >= SIMILARITY - 1e-12


def _node(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text)))


def _banded(batches):
    memo = Words()
    for batch in batches:
        for part in parts(batch, 256):
            nodes = part.column("node").to_pylist()
            first = {n: i for i, n in reversed(list(enumerate(nodes)))}  # copies in a batch once
            places = sorted(first.values())
            sets = counted(part.column("text").cast(pa.binary()).take(pa.array(places)).to_pylist(), memo)
            of, seen = views(sets)
            found: list[list] = [[] for _ in sets]
            for i, row in zip(of, bands(signatures(seen)), strict=True):
                found[i].append(row)
            some = [i for i, (x, _) in enumerate(sets) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[places[i]] for i in some], pa.binary()), pa.array([len(sets[i][0]) for i in some], pa.int32()), pa.array([len(found[i]) > 1 for i in some]),
                 pa.array([np.unique(np.concatenate(found[i])) for i in some], pa.list_(pa.int64()))],
                names=["node", "size", "repeats", "bands"])


def _sets(batches):
    """The weighted sets of texts; counts are null where all are 1."""
    memo = Words()
    for batch in (part for whole in batches for part in parts(whole, 256)):
        sets = counted(batch.column("text").cast(pa.binary()).to_pylist(), memo)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([x.view(np.int64) for x, _ in sets], pa.list_(pa.int64())), pa.array([n if n.max() > 1 else None for _, n in sets], pa.list_(pa.int64()))],
            names=["node", "elements", "counts"])


def _lists(column) -> list[np.ndarray | None]:
    """The lists of an Arrow column as views of its numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist(), strict=True)]


def _weighted(batch, elements: str = "elements", counts: str = "counts") -> list[tuple[np.ndarray, np.ndarray]]:
    x = [e.view(np.uint64) for e in _lists(batch.column(elements))]
    return [(e, np.ones(len(e), np.int64) if n is None else n) for e, n in zip(x, _lists(batch.column(counts)), strict=True)]


def _finer(batches):
    for batch in (part for whole in batches for part in parts(whole, 256, column="elements")):
        of, seen = views(_weighted(batch))
        fine: list[list] = [[] for _ in range(batch.num_rows)]
        for i, row in zip(of, fine_bands(signatures(seen)), strict=True):
            fine[i].append(row)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([np.unique(np.concatenate(x)) for x in fine], pa.list_(pa.int64()))], names=["node", "fine"])


def joining(sets: list[tuple[np.ndarray, np.ndarray]], components: list) -> list[tuple[int, int]]:
    """Pairs of similar sets that join their components: as few as connect what all similar pairs would.

    Plain similarities are one matrix product. Probability Jaccard is at most the share of either set's weight that lies
    on common elements, two more products; pairs that these leave, and that still join something, are computed.
    """
    lengths = np.fromiter((len(x) for x, _ in sets), np.int64, len(sets))
    _, column, n = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True, return_counts=True)
    row, weight = np.repeat(np.arange(len(sets)), lengths), np.concatenate([a for _, a in sets])
    weighted = len(weight) and weight.max() > 1
    share = weight / np.repeat([max(a.sum(), 1) for _, a in sets], lengths)
    on = np.flatnonzero((n > 1)[column])
    row, share, column = row[on], share[on], (np.cumsum(n > 1) - 1)[column[on]]
    common, overlap = np.zeros((2, len(sets), len(sets)), np.float32)
    by_column = np.argsort(column, kind="stable")
    ends = np.searchsorted(column[by_column], np.arange(0, int((n > 1).sum()) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        at = by_column[a:b]
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[at], column[at] - k * COLUMNS] = 1
        common += held @ held.T
        if weighted:
            parts_ = np.zeros_like(held)
            parts_[row[at], column[at] - k * COLUMNS] = share[at]
            overlap += parts_ @ held.T
    alike = common >= SIMILARITY * (lengths[:, None] + lengths[None] - common) - 1e-3
    perhaps = (overlap >= SIMILARITY - 1e-3) & (overlap.T >= SIMILARITY - 1e-3) & ~alike if weighted else np.zeros_like(alike)
    root = {c: c for c in components}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for pairs in (alike, perhaps):
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(pairs, 1))), strict=True):
            x, y = find(components[i]), find(components[j])
            if x != y and lengths[i] and lengths[j] and similar(sets[i], sets[j]):
                root[x] = y
                out.append((i, j))
    return out


def _tiled(batches):
    """Pairs of components that a link inside a tile joins; the rows of a tile come one after the other."""
    key, names, sets = None, [], []

    def done():
        if len(set(names)) < 2:
            return []
        return [(names[i], names[j]) for i, j in joining(sets, names)]

    for batch in (part for whole in batches for part in parts(whole, 1024, column="elements")):
        out = []
        for *tile, component, weighted in zip(*(batch.column(c).to_pylist() for c in ("b", "i", "j", "component")), _weighted(batch), strict=True):
            if tile != key:
                out += done()
                key, names, sets = tile, [], []
            names.append(component)
            sets.append(tuple(map(np.array, weighted)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["u", "v"])
    out = done()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["u", "v"])


def _verified(batches):
    for batch in (part for whole in batches for part in parts(whole, 1024, column="u_elements")):
        pairs = zip(_weighted(batch, "u_elements", "u_counts"), _weighted(batch, "v_elements", "v_counts"), strict=True)
        keep = pa.array([i for i, (a, b) in enumerate(pairs) if similar(a, b)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("u", "v")], names=["u", "v"])


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each of the nodes: copies are combined before anything is joined. Never by broadcast: the same plan at every size."""
    return docs.groupBy("node").agg(F.first("text").alias("text")).join(nodes.hint("merge"), "node", "left_semi")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes that are similar; sets without repeats of too different sizes are left out before."""
    fits = (F.least("u_size", "v_size") >= SIMILARITY * F.greatest("u_size", "v_size")) | F.col("u_repeats") | F.col("v_repeats")
    pairs = pairs.where(fits).select("u", "v").distinct()
    side = lambda k: sets.select(F.col("node").alias(k), F.col("elements").alias(f"{k}_elements"), F.col("counts").alias(f"{k}_counts"))
    known = looked_up(pairs.join(side("u"), "u"), side("v"), ["v"], "u")
    return materialise(known.mapInArrow(tidy(_verified), _LINK))


_LINK = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])
_SETS = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("elements", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def _several(placed: DataFrame) -> DataFrame:
    """The members (b, node, size, component) of buckets that hold several components, with n and total (of their sizes)."""
    found = placed.groupBy("b").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("component").alias("low"), F.max("component").alias("high"))
    return looked_up(placed, found.where("low <> high").select("b", "n", "total"), ["b"], "node")


def _open(members: DataFrame, named: DataFrame) -> DataFrame:
    """The members, with their component, of buckets of three or more that hold several components."""
    placed = members.where("n > 2").select("b", "node", "size").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return materialise(_several(placed))


def _cut(large: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of buckets cut by finer bands: (b, node, size, component, n, total) of those that hold several components."""
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("fine", T.ArrayType(T.LongType()))])
    fine = materialise(sets.join(large.select("node").distinct(), "node", "left_semi").mapInArrow(tidy(_finer), schema))
    rows = large.drop("n", "total").join(fine, "node").select(F.col("b").alias("outer"), "node", "size", "component", F.explode("fine").alias("f"))
    return materialise(_several(rows.select(F.xxhash64("outer", "f").alias("b"), "node", "size", "component")))


def _inside(members: DataFrame, sets: DataFrame) -> DataFrame:
    """All links between components inside the buckets, tile by tile, as pairs of components."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / ELEMENTS)).cast("int")
    tiles = members.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = tiles.select("b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component")
    rows = looked_up(tiles, sets, ["node"], "b").repartition("b", "i", "j").sortWithinPartitions("b", "i", "j")
    return materialise(rows.select("b", "i", "j", "component", "elements", "counts").mapInArrow(tidy(_tiled), _LINK))


def linked(docs: DataFrame) -> DataFrame:
    """(node, component) of all texts with a similar one; docs has node (md5 of the text) and text."""
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("repeats", T.BooleanType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    banded = docs.mapInArrow(tidy(_banded), schema).groupBy("node").agg(F.first("size").alias("size"), F.first("repeats").alias("repeats"), F.first("bands").alias("bands"))
    banded = materialise(banded)
    rows = banded.select("node", "size", "repeats", F.explode("bands").alias("b")).withColumn("own", F.struct("node", "size", "repeats"))
    members = with_least(rows, ["b"], "own", "p", count="n", having="n > 1")
    members = materialise(members.select("b", "n", "node", "size", "repeats", F.col("p.node").alias("v"), F.col("p.size").alias("v_size"), F.col("p.repeats").alias("v_repeats")))
    discard(banded)
    sets = materialise(_texts(docs, members.select("node").distinct()).mapInArrow(tidy(_sets), _SETS))
    pairs = members.where("node <> v").select(F.col("node").alias("u"), F.col("size").alias("u_size"), F.col("repeats").alias("u_repeats"), "v", "v_size", "v_repeats")
    links = _links(pairs, sets)
    named = materialise(components(links))
    opened = _open(members, named)
    discard(members)
    discard(links)
    large = opened.where(F.col("n") > BLOCK)
    tiled = opened.where(F.col("n") <= BLOCK)
    found = _inside(tiled if large.isEmpty() else tiled.unionByName(_cut(large, sets)), sets)
    discard(sets)
    discard(opened)
    if found.isEmpty():
        return named
    joined = materialise(components(found).select(F.col("node").alias("component"), F.col("component").alias("into")))
    # a component of one text isn't in `named`, so its node is looked up as well
    alone = joined.join(named.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("into").alias("component"))
    whole = named.select("component").distinct().join(joined, "component", "left").select("component", F.coalesce("into", "component").alias("into"))
    known = looked_up(named, whole, ["component"], "node").select("node", F.col("into").alias("component"))
    return materialise(known.unionByName(alone))


def _heads(docs: DataFrame, node: str, doc_id: str) -> DataFrame:
    """A row for each text: node, its own smallest id (own.doc_id), the salts of its rows' ids, and the head of its class."""
    named = linked(docs.where(F.col("text").isNotNull()).select(F.col(node).alias("node"), "text"))
    least = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"))).alias("own")
    own = docs.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(least, salts_held(salt(doc_id)).alias("salts"))
    own = materialise(own.withColumn("head", F.struct("own.none", "own.doc_id", "node")).join(named, "node", "left"))
    headed = with_least(own.where("component IS NOT NULL").withColumnRenamed("head", "mine"), ["component"], "mine", "head")
    return headed.select("node", "salts", "head").unionByName(own.where("component IS NULL").select("node", "salts", "head"))


def classes(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, class_id (smallest id of its class), node and whether it is the one to keep."""
    rows = docs.select("doc_id", "text", _node().alias("node"))
    heads = for_each_salt(_heads(rows, "node", "doc_id"), "salts", "salt")
    out = rows.where("node IS NOT NULL").select("doc_id", "node", salt("doc_id").alias("salt")).join(heads, ["node", "salt"])
    copy = F.row_number().over(Window.partitionBy("node", "salt", "doc_id").orderBy("doc_id"))  # repeated rows are equal here
    kept = (F.col("head.node") == F.col("node")) & F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (copy == 1)
    out = out.select("doc_id", F.col("head.doc_id").alias("class_id"), "node", kept.alias("kept"))
    # a null text is alone: its id stands for its class
    alone = rows.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), "node", F.lit(True).alias("kept"))
    return out.unionByName(alone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, in the documents' own columns; documents without a text stay."""
    node, head, copy = unused("node", docs), unused("head", docs), unused("copy", docs)
    keyed = docs.withColumn(node, _node())
    heads = _heads(keyed.select("doc_id", "text", node), node, "doc_id").where(F.col("head.node") == F.col("node")).select(F.col("node").alias(head), "head.doc_id")
    texts = keyed.where(F.col("text").isNotNull())
    heads = heads.withColumnRenamed("doc_id", copy)
    kept = texts.join(heads, (texts[node] == heads[head]) & texts["doc_id"].eqNullSafe(heads[copy])).drop(head, copy)
    first = F.row_number().over(Window.partitionBy(node, "doc_id").orderBy(node))
    return kept.withColumn(copy, first).where(F.col(copy) == 1).select(*docs.columns).unionByName(docs.where(F.col("text").isNull()))
