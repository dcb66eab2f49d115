"""A Merkle manifest of a dataset: a tree of digests for each group of rows, one over the groups' roots, and proofs.

A row's leaf is the digest of its columns. Leaves of a group stand in an order; runs of `fanout` consecutive nodes become the
digest of their digests (hexadecimal, one after the other), level by level, until one node is left. A short run at the end is
digested as it is, without padding, even a run of one.

Rows are range-partitioned by group and order, and counted, so that each knows its place in its group. Each partition then
keeps a mountain range: for every level a stack of the nodes of an open run. A leaf is pushed; a full run carries, as in
counting to the base `fanout`, into a node of the level above; memory is a run for each level. A run whose beginning or end
lies in another partition stays open: such edges, a few for each level and partition, meet in groups of MERGE neighbouring
partitions, again and again, until every run is complete. No task sees more than the edges of MERGE partitions.

A proof holds the other nodes of each run on the way from a leaf to the root. The way is cut at level BLOCK: what lies below is
made again from the block's own leaves, what lies above is looked up once for each block, not for each row.

Defined cases: rows that are equal in group and order stand in the order of their leaves; those with a null in the order come
first; null groups are a group of their own and come first, the others by code point. A null column has a mark of its own in
the leaf, unlike any text. A tree of one leaf has that leaf as root and an empty proof. An empty table has no rows, no nodes and no root (None).
Columns that aren't named in `columns` are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, looked_up, materialise, tidy

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, BLOCK, MERGE, OUT = 2, 8, 32, 4096

_NODE = "part int, tree string, level int, at long, digest binary, n long, edge boolean"


def leaf(*values: Column) -> Column:
    """The digest of the values: each as its number of UTF-8 bytes, a colon and itself, or a dash if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number division; `/` would go through doubles."""
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def _powers(fanout: int) -> list[int]:
    out = [1]
    while out[-1] * fanout < 1 << 63:
        out.append(out[-1] * fanout)
    return out


def _height(n: Column, fanout: int) -> Column:
    """The root's level in a tree of n leaves."""
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in _powers(fanout)]), lambda p: p < n))


def _nodes_at(n: int, level: int, fanout: int) -> int:
    return -(-n // fanout**level)


class Range:
    """The mountain range of one tree in one partition. Nodes are pushed in order; `made` takes the nodes that runs become."""

    def __init__(self, n: int, fanout: int, made):
        self.n, self.fanout, self.made = n, fanout, made
        self.open: list[list[tuple[int, bytes]]] = []  # by level: the nodes of the open run
        self.edges: list[tuple[int, int, bytes]] = []

    def push(self, at: int, digest: bytes) -> None:
        level = 0
        while (size := _nodes_at(self.n, level, self.fanout)) > 1:
            if level == len(self.open):
                self.open.append([])
            run, first = self.open[level], at - at % self.fanout
            run.append((at, digest))
            if at < min(first + self.fanout, size) - 1:
                return
            if run[0][0] != first:  # it begins in a partition before this one
                self.edges += [(level, *node) for node in run]
                run.clear()
                return
            digest, at, level = folded([d for _, d in run]), at // self.fanout, level + 1
            run.clear()
            self.made(level, at, digest)

    def close(self) -> list[tuple[int, int, bytes]]:
        """The nodes (level, at, digest) whose run isn't complete in this partition."""
        return self.edges + [(level, *node) for level, run in enumerate(self.open) for node in run]


def merged(nodes: list[tuple[int, int, bytes]], n: int, fanout: int) -> tuple[list, list]:
    """From the edges of neighbouring partitions: the nodes that their complete runs become, and the edges that remain."""
    levels: dict[int, dict[int, bytes]] = {}
    for level, at, digest in nodes:
        levels.setdefault(level, {})[at] = digest
    made, edges = [], []
    level = min(levels, default=0)
    while levels:
        if (held := levels.pop(level, None)) is not None:
            size = _nodes_at(n, level, fanout)
            for run in sorted({at // fanout for at in held}):
                own = [at for at in range(run * fanout, min(run * fanout + fanout, size)) if at in held]
                if len(own) == min(fanout, size - run * fanout):
                    node = (level + 1, run, folded([held[at] for at in own]))
                    made.append(node)
                    if _nodes_at(n, level + 1, fanout) > 1:
                        levels.setdefault(level + 1, {})[run] = node[2]
                else:
                    edges += [(level, at, held[at]) for at in own]
        level += 1
    return made, edges


@dataclass
class Forest:
    """rows: (tree, id, digest, claimed, part, at, n), a leaf each; nodes: (tree, level, at, digest, n) of level 1 and above."""

    rows: DataFrame
    nodes: DataFrame
    fanout: int

    def roots(self) -> DataFrame:
        """(tree, digest)."""
        top = self.nodes.where(F.col("level") == _height(F.col("n"), self.fanout)).select("tree", "digest")
        return top.unionByName(self.rows.where("n = 1").select("tree", "digest"))

    def steps(self, level: int) -> DataFrame:
        """(tree, block, steps): for each node of a level, from it to the root, its place in its run and the run's digests."""
        f, powers = self.fanout, F.array(*[F.lit(p).cast("long") for p in _powers(self.fanout)])
        every = self.nodes.where(F.col("level") >= level).select("tree", "level", "at", "digest", "n")
        if level == 0:
            every = every.unionByName(self.rows.select("tree", F.lit(0).alias("level"), "at", "digest", "n"))
        every = every.withColumn("height", _height(F.col("n"), f)).where("level < height")
        runs = every.groupBy("tree", "level", _div(F.col("at"), f).alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("nodes"))
        runs = runs.withColumn("nodes", F.transform("nodes", lambda x: x["digest"]))
        asked = every.where(F.col("level") == level).select("tree", F.col("at").alias("block"), F.explode(F.sequence(F.lit(level), F.col("height") - 1)).alias("level"))
        asked = asked.withColumn("at", _div(F.col("block"), F.get(powers, F.col("level") - level))).withColumn("run", _div(F.col("at"), f))
        met = looked_up(asked, runs, ["tree", "level", "run"], "block")
        way = F.sort_array(F.collect_list(F.struct("level", (F.col("at") % f).cast("int").alias("place"), "nodes")))
        return met.groupBy("tree", "block").agg(F.transform(way, lambda x: F.struct(x["place"].alias("place"), x["nodes"].alias("nodes"))).alias("steps"))


def _numbered(batches):
    """Each row's partition, and its place among the partition's rows of its tree."""
    part, tree, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        within = []
        for x in batch.column("tree").to_pylist():
            tree, n = (x, n) if x == tree else (x, 0)
            within.append(n)
            n += 1
        columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(within, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "within"])


_ARROW = pa.schema([("part", pa.int32()), ("tree", pa.string()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("edge", pa.bool_())])


def _table(rows: list[tuple]) -> dict:
    return dict(zip(_ARROW.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {c: [] for c in _ARROW.names}


def _stacked(fanout: int):
    def stacked(batches):
        out: list[tuple] = []
        key, peaks = None, None

        def closed():
            return [] if peaks is None else [(key[0], key[1], *edge, peaks.n, True) for edge in peaks.close()]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "tree", "at", "digest", "n")]
            for part, tree, at, digest, n in zip(*columns, strict=True):
                if (part, tree) != key:
                    out += closed()
                    key = (part, tree)
                    peaks = Range(n, fanout, lambda level, at, digest, k=key, n=n: out.append((*k, level, at, digest, n, False)))
                peaks.push(at, digest)
            if len(out) > OUT:
                yield pa.RecordBatch.from_pydict(_table(out), _ARROW)
                out.clear()
        out += closed()
        yield pa.RecordBatch.from_pydict(_table(out), _ARROW)

    return stacked


def forest(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> Forest:
    """The trees of (tree, id, digest, claimed, the columns of the order): written leaves, since partitioning reads them twice."""
    kept = [leaves.schema[c] for c in ("tree", "id", "digest", "claimed")]
    ranged = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).select(*[f.name for f in kept])
    numbered = materialise(ranged.mapInArrow(tidy(_numbered), T.StructType([*kept, T.StructField("part", T.IntegerType()), T.StructField("within", T.LongType())])))
    sizes = numbered.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")  # a row for each partition that has rows of the tree
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(sizes.select("tree", "part", before.alias("start"), F.sum("rows").over(whole).alias("n")))
    rows = numbered.join(starts, ["tree", "part"]).select("tree", "id", "digest", "claimed", "part", (F.col("start") + F.col("within")).alias("at"), "n")
    placed = rows.select("part", "tree", "at", "digest", "n").repartition("part").sortWithinPartitions("part", "tree", "at")
    found = materialise(placed.mapInArrow(tidy(_stacked(fanout)), _NODE))
    nodes, edges = found.where("NOT edge"), found.where("edge")

    def meet(table: pa.Table) -> pa.Table:
        trees: dict[str, tuple[int, list]] = {}
        part = table["part"][0].as_py()
        for tree, level, at, digest, n in zip(*[table[c].to_pylist() for c in ("tree", "level", "at", "digest", "n")], strict=True):
            trees.setdefault(tree, (n, []))[1].append((level, at, digest))
        out = []
        for tree, (n, own) in trees.items():
            made, left = merged(own, n, fanout)
            out += [(part, tree, *x, n, False) for x in made] + [(part, tree, *x, n, True) for x in left]
        return pa.Table.from_pydict(_table(out), _ARROW)

    parts = (starts.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // MERGE)
        met = materialise(edges.withColumn("part", _div(F.col("part").cast("long"), MERGE).cast("int")).groupBy("part").applyInArrow(meet, _NODE))
        nodes, edges = nodes.unionByName(met.where("NOT edge")), met.where("edge")
    return Forest(rows, nodes.drop("part", "edge"), fanout)


@dataclass
class Manifest:
    """groups: a tree of each group's leaves; over: the tree of their roots (of which the ids are the groups); root: hexadecimal."""

    groups: Forest
    over: Forest
    root: str | None


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", columns=COLUMNS, claimed: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of a table. `claimed`: other leaves, in hexadecimal, that `proofs` folds in place of the rows' own; null: none."""
    own = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(order).alias("id"), F.unhex(leaf(*[F.col(c) for c in columns])).alias("digest"),
        F.unhex(F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"), F.monotonically_increasing_id().alias("row"))
    leaves = materialise(own)
    groups = forest(leaves, ["id", "digest", "row"], fanout)  # the last one spreads equal leaves over partitions
    roots = materialise(groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest", F.lit(None).cast("binary").alias("claimed")))
    over = forest(roots, ["id"], fanout)
    for written in (leaves, roots):
        discard(written)
    root = over.roots().first()
    return Manifest(groups, over, root and root["digest"].hex())


def _proved(fanout: int):
    def proved(rows: pa.Table, way: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        ids, own, claimed = rows["id"].combine_chunks(), rows["digest"].to_pylist(), rows["claimed"].to_pylist()
        n, subroot = rows["n"][0].as_py(), way["subroot"][0].as_py().hex()
        steps = [(s["place"], s["nodes"]) for s in way["steps"][0].as_py()]
        levels = [own]
        while len(levels) <= BLOCK and _nodes_at(n, len(levels) - 1, fanout) > 1:
            last = levels[-1]
            levels.append([folded(last[a : a + fanout]) for a in range(0, len(last), fanout)])
        proofs, ends = [], []
        for i, (mine, other) in enumerate(zip(own, claimed, strict=True)):
            digest, siblings, at = other or mine, [], i
            for nodes in levels[:-1]:
                first = at - at % fanout
                run = nodes[first : first + fanout]
                run[at - first] = digest
                siblings += run[: at - first] + run[at - first + 1 :]
                digest, at = folded(run), at // fanout
            for place, nodes in steps:
                siblings += nodes[:place] + nodes[place + 1 :]
                digest = folded([*nodes[:place], digest, *nodes[place + 1 :]])
            proofs.append(folded(siblings).hex())
            ends.append(digest.hex())
        columns = [ids, pa.array([d.hex() for d in own]), pa.array([subroot] * len(own)), pa.array(proofs), pa.array(ends)]
        return pa.Table.from_arrays(columns, names=["id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return proved


def proofs(found: Manifest, id: str = "doc_id") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): every row's proof, folded from its claimed leaf or its own.

    proof_sha256 is the digest of the proof's nodes, from the leaf's run to the last one below the root.
    """
    groups, f = found.groups, found.groups.fanout
    rows = groups.rows.withColumn("block", _div(F.col("at"), f**BLOCK)).select("tree", "block", "id", "digest", "claimed", "at", "n")
    blocks = rows.select("tree", "block").distinct()
    names = found.over.rows.select(F.col("tree").alias("all"), F.col("at").alias("block"), F.col("id").alias("tree"), F.col("digest").alias("subroot"))
    above = found.over.steps(0).select(F.col("tree").alias("all"), "block", F.col("steps").alias("above"))
    tops = names.join(above, ["all", "block"], "left").select("tree", "subroot", "above")
    kind = above.schema["above"].dataType
    way = looked_up(blocks.join(groups.steps(BLOCK), ["tree", "block"], "left"), materialise(tops), ["tree"], "block")
    none = F.array().cast(kind)
    way = materialise(way.select("tree", "block", "subroot", F.concat(F.coalesce("steps", none), F.coalesce("above", none)).alias("steps")))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")]])
    out = rows.groupBy("tree", "block").cogroup(way.groupBy("tree", "block")).applyInArrow(_proved(f), schema)
    root = F.lit(found.root).cast("string")
    return out.select(F.col("id").alias(id), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _field(value: str) -> str:
    text = f"({value})::VARCHAR"
    return f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"


#: The unsigned crc32 of a short text, bit by bit.
_CRC = """(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(id) + 1), lambda i: list_concat([ord(id[i])::BIGINT + 256], repeat([0::BIGINT], 8))))),
  lambda c, x: CASE WHEN x > 0 THEN xor(c, x - 256) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT))"""

#: The query's rows in SQL, at fanout 2.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({' || '.join(_field(c) for c in COLUMNS)}) AS leaf,
    sha256({' || '.join(_field('n_chars::HUGEINT + 1' if c == 'n_chars' else c) for c in COLUMNS)}) AS other, doc_id::VARCHAR AS id
  FROM documents
), placed AS (
  SELECT doc_id, tree, leaf, CASE WHEN {_CRC} % 7 = 0 THEN other ELSE leaf END AS claimed,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
), low AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS (SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 2, n
), every AS (
  SELECT tree, level, pos, n, digest FROM low WHERE n > 1
  UNION ALL SELECT s.tree, s.height + h.level, h.pos, h.n, h.digest FROM high h JOIN subroots s ON h.pos IN ((s.pos >> h.level), xor(s.pos >> h.level, 1)) WHERE h.n > 1
), way AS (
  SELECT p.tree, p.pos AS leaf_at, g AS level, CASE WHEN g < s.height THEN p.pos >> g ELSE s.pos >> (g - s.height) END AS place
  FROM placed p JOIN subroots s USING (tree), unnest(range(0, 128)) AS t(g)
), siblings AS (
  SELECT w.tree, leaf_at, w.level, place % 2 AS side, e.digest FROM way w
  JOIN every own ON own.tree = w.tree AND own.level = w.level AND own.pos = w.place
  LEFT JOIN every e ON e.tree = w.tree AND e.level = w.level AND e.pos = xor(w.place, 1)
), ways AS (
  SELECT tree, leaf_at, sha256(coalesce(string_agg(digest, '' ORDER BY level), '')) AS proof_sha256, list({{side: side, digest: digest}} ORDER BY level) AS steps FROM siblings GROUP BY tree, leaf_at
), fold AS (
  SELECT p.tree, p.pos, 0 AS k, p.claimed AS h, coalesce(w.steps, []) AS steps FROM placed p LEFT JOIN ways w ON w.tree = p.tree AND w.leaf_at = p.pos
  UNION ALL SELECT tree, pos, k + 1, sha256(CASE WHEN steps[k + 1].digest IS NULL THEN h WHEN steps[k + 1].side = 0 THEN h || steps[k + 1].digest ELSE steps[k + 1].digest || h END), steps FROM fold WHERE k < len(steps)
), root AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, coalesce(w.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM placed p JOIN subroots s USING (tree) LEFT JOIN ways w ON w.tree = p.tree AND w.leaf_at = p.pos JOIN fold f ON f.tree = p.tree AND f.pos = p.pos AND f.k = len(f.steps), root
"""
