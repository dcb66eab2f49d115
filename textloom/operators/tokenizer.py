"""Byte-level BPE: pretoken counts, training and encoding.

Words are counted once with a partial aggregation before anything costly, and every later step of training works on
distinct words: on the driver, if there are no more than `driver_words` of them (about 2 kB of its memory each), else in
rounds over pair counts and an inverted index that are kept up to date by differences. Encoding merges each
distinct word that a task meets once and gathers ids by array operations, for any number of merges.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bytes as B
from ..functions import text as X
from ..sources.shared import discard, materialise, own_dir, unused

EOT = "<|endoftext|>"
INDEXED, PASSED = 200_000, 1_000  # distinct words, beyond which so many merges are learned by passes
GUESSED, SAMPLE, WORD_SLICE = 64, 50_000, 1 << 16
SLICE, PART, WORDS = 2 << 20, 1 << 20, 1 << 17  # of the texts encoded at once: bytes, characters and words
DRIVER_WORDS, ROUND_WORDS, TOP, RANKED, REMEMBERED, BUCKETS, COMPACT = 500_000, 200_000, 512, 8_192, 500_000, 16, 16
Merges = list[tuple[str, str]]


def pretoken_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, idx, word): every pretoken of every document."""
    return docs.select("doc_id", F.posexplode(X.pretokens(text)).alias("idx", "word"))


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents."""
    return docs.select(F.explode(X.pretokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_symbols(counts: DataFrame) -> DataFrame:
    """(symbols, n): the distinct words as wrapped byte symbols."""
    return counts.select(B.wrapped(F.col("word")).alias("symbols"), "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """(l, r, n): adjacent symbols, overlapping ones too, weighted by the words' counts."""
    parts = B.unwrapped(F.col("symbols"))
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda r, i: F.struct(F.get(parts, i).alias("l"), r.alias("r")))
    return words.select(F.explode(pairs).alias("p"), "n").groupBy("p.l", "p.r").agg(F.sum("n").alias("n"))


def top_pairs(pairs: DataFrame, n: int) -> list[tuple[int, str, str]]:
    """The n most frequent pairs (count, l, r), of equals the largest by code points first."""
    return [(r["n"], r["l"], r["r"]) for r in pairs.orderBy(F.desc("n"), F.desc("l"), F.desc("r")).limit(n).collect()]


def independent(top: list[tuple[int, str, str]], complete: bool) -> list[tuple[str, str]]:
    """The first of the ranked pairs that merging one after the other would learn in this order.

    Merging a pair changes only counts of pairs that touch its symbols, and a new pair's count is at most that of a pair that
    touched them. So a pair is safe as long as no pair of its count or a larger one touches the symbols of those before it. Unless
    `complete` the list goes on, maybe with pairs of the last one's count.
    """
    out: list[tuple[str, str]] = []
    touched: set[str] = set()
    for n, left, right in top:
        if out and (not complete and n == top[-1][0] or any(m == n and (x in touched or y in touched) for m, x, y in top) or left in touched or right in touched):
            break
        out.append((left, right))
        touched |= {left, right, left + right}
        if left == right:  # what a run of one symbol becomes touches no other pair
            break
    return out


class _Pairs:
    """Pair counts and the pairs of each count."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.count, self.at = {}, defaultdict(set)
        self.change(counts)

    def change(self, by: dict[tuple[str, str], int]) -> None:
        for pair, n in by.items():
            before = self.count.pop(pair, 0)
            if before and n:
                self.at[before].discard(pair)
                if not self.at[before]:
                    del self.at[before]
            now = before + n
            if now:
                self.count[pair] = now
                self.at[now].add(pair)

    def best(self) -> tuple[str, str] | None:
        return max(self.at[max(self.at)]) if self.at else None


def _merged(symbols: list[str], pair: tuple[str, str]) -> tuple[list[str], list, list]:
    """The symbols with the pair merged from left to right, the pairs that go by that and the pairs that come: those around merged places."""
    left, right = pair
    places, k, last = [], 0, len(symbols) - 1
    while k < last:
        if symbols[k] == left and symbols[k + 1] == right:
            places.append(k)
            k += 1
        k += 1
    new, at = [], 0
    for k in places:
        new += symbols[at:k]
        new.append(left + right)
        at = k + 2
    new += symbols[at:]
    gone = {j for k in places for j in (k - 1, k, k + 1) if 0 <= j < last}
    came = {j for i, k in enumerate(places) for j in (k - i - 1, k - i) if 0 <= j < len(new) - 1}
    return new, [(symbols[j], symbols[j + 1]) for j in gone], [(new[j], new[j + 1]) for j in came]


def _learned(words: dict[str, int], merges: Merges, counts: dict[tuple[str, str], int] | None, beyond: int, n_merges: int) -> Merges:
    """The next merges, from words that hold all pairs of `counts` (None: these are all words), as long as the best pair counts for more
    than `beyond`. A merge touches the words that hold it, and there its surroundings."""
    ranks = {m: i for i, m in enumerate(merges)}
    split = [bpe_word(w, ranks) for w in words]
    weight = list(words.values())
    known: dict[tuple[str, str], int] = defaultdict(int)
    held: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, symbols in enumerate(split):
        for p in pairwise(symbols):
            known[p] += weight[i]
            held[p].add(i)
    pairs, found = _Pairs(known if counts is None else counts), []
    while len(found) < n_merges and (best := pairs.best()) is not None and pairs.count[best] > beyond:
        found.append(best)
        change: dict[tuple[str, str], int] = defaultdict(int)
        for i in held.pop(best):
            split[i], gone, came = _merged(split[i], best)
            for p in gone:
                change[p] -= weight[i]
            for p in came:
                change[p] += weight[i]
                held[p].add(i)
        pairs.change(change)
    return found


def train_words(words: dict[str, int], n_merges: int) -> Merges:
    """Merges learned from words and their counts in memory."""
    return _learned(words, [], None, 0, n_merges)


_CHANGES = "l string, r string, d long, held long, word string, n long"


def _changed(before: Merges | None, after: Merges):
    """For distinct (word, n): what a word's pairs count for more or less (d, and in how many words: held) once `after` are all merges
    instead of `before` (None: before the word was counted at all). Rows of pairs that the word hasn't held carry it along."""

    def changed(batches):
        old, new = None if before is None else {m: i for i, m in enumerate(before)}, {m: i for i, m in enumerate(after)}
        for batch in (batch.slice(at, 4096) for batch in batches for at in range(0, batch.num_rows, 4096)):
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                gone, came = (Counter() if ranks is None else Counter(pairwise(bpe_word(word, ranks))) for ranks in (old, new))
                for p in gone.keys() | came.keys():
                    if d := came[p] - gone[p]:
                        rows.append((*p, d * n, (p in came) - (p in gone), None if p in gone else word, n))
            yield pa.RecordBatch.from_pydict(dict(zip(("l", "r", "d", "held", "word", "n"), zip(*rows, strict=True) if rows else [()] * 6, strict=True)), _CHANGES_ARROW)

    return changed


_CHANGES_ARROW = pa.schema([("l", pa.string()), ("r", pa.string()), ("d", pa.int64()), ("held", pa.int64()), ("word", pa.string()), ("n", pa.int64())])


class PairIndex:
    """Pair counts of distinct words, and an inverted index pair -> words, both kept up to date by differences.

    Merging touches only words that hold a merged pair; the index finds them, and what they count for before and after goes to a
    log: differences of counts, and the words of pairs that are new in them. Words aren't rewritten: their symbols follow from the merges so far.
    Entries of pairs that a word no longer holds may stay in the index; they find words that don't change. The first log is partitioned by a hash of the
    pair (BUCKETS), so a round reads the parts that its pairs are in; later ones are put together every COMPACT rounds.
    """

    def __init__(self, counts: DataFrame, merges: Merges = ()):
        self.spark, self.merges = counts.sparkSession, [*merges]
        first = counts.select("word", "n").mapInArrow(_changed(None, self.merges), _CHANGES)
        path = f"{own_dir(self.spark)}/{uuid.uuid4().hex}"
        first.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)
        self.base = self.spark.read.schema(f"{_CHANGES}, bucket int").parquet(path)
        self.base._textloom_path = path
        self.logs: list[DataFrame] = []
        self.pairs = materialise(self.base.groupBy("l", "r").agg(F.sum("d").alias("n"), F.sum("held").alias("held")))

    @staticmethod
    def _bucket() -> Column:
        return (F.crc32(F.concat("l", F.lit(" "), "r")) % BUCKETS).cast("int")

    def top(self, n: int) -> list[tuple[int, str, str, int]]:
        """(count, l, r, words that hold it) of the n most frequent pairs, of equals the largest by code points first."""
        return [(r["n"], r["l"], r["r"], r["held"]) for r in self.pairs.orderBy(F.desc("n"), F.desc("l"), F.desc("r")).limit(n).collect()]

    def words(self, pairs: list[tuple[str, str]]) -> DataFrame:
        """(word, n): the distinct words that hold one of the pairs, and perhaps some more."""
        wanted = self.spark.createDataFrame(pairs, "l string, r string")
        buckets = {crc32(f"{left} {right}".encode()) % BUCKETS for left, right in pairs}
        found = self.base.where(F.col("bucket").isin(*buckets)).drop("bucket")
        for log in self.logs:
            found = found.unionByName(log)
        return found.where("word IS NOT NULL").join(F.broadcast(wanted), ["l", "r"], "left_semi").select("word", "n").distinct()  # RANKED pairs at most

    def learn(self, found: Merges) -> None:
        """Merge the pairs, one after the other, in all words that hold them."""
        after = [*self.merges, *found]
        log = materialise(self.words(found).mapInArrow(_changed(self.merges, after), _CHANGES))
        change = log.groupBy("l", "r").agg(F.sum("d").alias("n"), F.sum("held").alias("held"))
        pairs = materialise(self.pairs.unionByName(change).groupBy("l", "r").agg(F.sum("n").alias("n"), F.sum("held").alias("held")).where("n > 0"))
        discard(self.pairs)
        self.pairs, self.merges = pairs, after
        self.logs.append(log)
        if len(self.logs) >= COMPACT:
            whole = self.logs[0]
            for one in self.logs[1:]:
                whole = whole.unionByName(one)
            whole = materialise(whole.where("word IS NOT NULL").coalesce(max(1, self.spark.sparkContext.defaultParallelism)))
            for one in self.logs:
                discard(one)
            self.logs = [whole]

    def close(self) -> None:
        for written in (self.base, self.pairs, *self.logs):
            discard(written)


def _batch(top: list[tuple[int, str, str, int]], budget: int, complete: bool) -> int:
    """How many of the ranked pairs are held by `budget` words at most in all, whole groups of equal counts only."""
    upto, k = 0, 0
    for i, (n, _, _, held) in enumerate(top):
        upto += held
        if upto > budget:
            break
        if i + 1 == len(top) and complete or i + 1 < len(top) and top[i + 1][0] < n:
            k = i + 1
    return k


class _Symbols:
    """Numbers of symbols: the alphabet's in the order of the bytes, then those of the merges; equal symbols share one."""

    def __init__(self, merges: Merges):
        self.names = list(B.ALPHABET)
        self.number = {x: i for i, x in enumerate(self.names)}
        self.merges = [(self.number[left], self.number[right], self.add(left + right)) for left, right in merges]

    def add(self, name: str) -> int:
        if name not in self.number:
            self.number[name] = len(self.names)
            self.names.append(name)
        return self.number[name]


def _joined(at: np.ndarray, left: int, right: int) -> np.ndarray:
    """Places of a pair in the symbols of many words, from left to right without overlap."""
    k = np.flatnonzero((at[:-1] == left) & (at[1:] == right))
    if left == right and len(k):  # of a run every second place
        run = np.concatenate(([0], np.flatnonzero(np.diff(k) != 1) + 1))
        k = k[(np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))) % 2 == 0]
    return k


def _after(at: np.ndarray, k: np.ndarray, new: int) -> np.ndarray:
    """The symbols with those at k and behind merged."""
    if not len(k):
        return at
    at = at.copy()
    at[k] = new
    return np.delete(at, k + 1)


def _split_words(batches, merges: list[tuple[int, int, int]]):
    """(symbols of many words, each -1 behind its word, and the word's place; places' counts) with the merges applied, a slice of words at a time."""

    def slices():
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= WORD_SLICE:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    for table in slices():
        word = pa.concat_arrays([c.cast(pa.large_binary()) for c in table.column("word").chunks])
        ends = np.frombuffer(word.buffers()[1], np.int64)[word.offset : word.offset + len(word) + 1]
        raw = np.frombuffer(word.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int32)
        at = np.insert(raw, ends[1:] - ends[0], -1)
        for left, right, new in merges:
            at = _after(at, _joined(at, left, right), new)
        yield at, table.column("n").to_numpy()


def _pair_sums(at: np.ndarray, n: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (left << 32 | right) at the places (None: all), their counts by the words' n, and in how many words they stand."""
    word = np.cumsum(at == -1)
    k = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0)) if places is None else places
    key, place = (at[k].astype(np.int64) << 32) | at[k + 1], word[k]
    order = np.argsort(key, kind="stable")  # places stay ascending
    key, place = key[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n[place], first) if len(first) else np.zeros(0, np.int64)
    once = np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1]))) if len(key) else np.zeros(0, bool)
    held = np.add.reduceat(once.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return key[first], sums, held


_SUMS = "step int, pair long, d long, held long"


def _sums_batch(step: int, key, d, held):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), step, np.int32)), pa.array(key, pa.int64()), pa.array(d, pa.int64()), pa.array(held, pa.int64())], names=["step", "pair", "d", "held"])


def _counted(merges: list[tuple[int, int, int]], place: list[int]):
    """For distinct (word, n): the pairs of the merged words, in all and in how many words; a symbol is named by its place among all by code points."""

    def counted(batches):
        ranked = np.array(place, np.int64)
        for at, n in _split_words(batches, merges):
            key, sums, held = _pair_sums(at, n)
            yield _sums_batch(0, ranked[key >> 32] << 32 | ranked[key & 0xFFFFFFFF], sums, held)

    return counted


def _stepped(merges: list[tuple[int, int, int]], guess: list[tuple[int, int, int]]):
    """For distinct (word, n): by how much each step of the guess changes the counts of the pairs around it."""

    def around(at, k):
        near = np.unique(np.concatenate((k - 1, k, k + 1)))
        near = near[(near >= 0) & (near < len(at) - 1)]
        return near[(at[near] >= 0) & (at[near + 1] >= 0)]

    def stepped(batches):
        for at, n in _split_words(batches, merges):
            for step, (left, right, new) in enumerate(guess):
                if not len(k := _joined(at, left, right)):
                    continue
                key, d, _ = _pair_sums(at, n, around(at, k))
                yield _sums_batch(step, key, -d, np.zeros(len(d), np.int64))
                at = _after(at, k, new)
                moved = k - np.arange(len(k))
                near = np.unique(np.concatenate((moved - 1, moved)))
                near = near[(near >= 0) & (near < len(at) - 1)]
                key, d, _ = _pair_sums(at, n, near[(at[near] >= 0) & (at[near + 1] >= 0)])
                yield _sums_batch(step, key, d, np.zeros(len(d), np.int64))

    return stepped


def _holding(merges: list[tuple[int, int, int]], wanted: list[tuple[int, int]]):
    """The distinct (word, n) that hold one of the pairs."""

    def holding(batches):
        keys = np.array([left << 32 | right for left, right in wanted], np.int64)
        for batch in batches:
            for at, _ in _split_words([batch], merges):
                k = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
                hit = k[np.isin((at[k].astype(np.int64) << 32) | at[k + 1], keys)]
                yield batch.take(pa.array(np.unique(np.cumsum(at == -1)[hit])))

    return holding


def _guess(some: dict[str, int], merges: Merges, exact: dict[tuple[str, str], int], n_merges: int) -> Merges:
    """Merges that may be the next, by the exact counts and what the sample's words say about their changes, scaled up."""
    ranks = {m: i for i, m in enumerate(merges)}
    split, weight = [bpe_word(w, ranks) for w in some], list(some.values())
    own: dict[tuple[str, str], float] = defaultdict(float)
    held: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, symbols in enumerate(split):
        for p in pairwise(symbols):
            own[p] += weight[i]
            held[p].add(i)
    likely, found = dict(exact), []
    while len(found) < n_merges and likely:
        best = max(likely, key=lambda p: (likely[p], p))
        scale = likely.pop(best) / own[best] if own[best] else 1.0
        found.append(best)
        for i in held.pop(best, ()):
            split[i], gone, came = _merged(split[i], best)
            for p in gone:
                own[p] -= weight[i]
                if p in likely:
                    likely[p] -= weight[i] * scale
            for p in came:
                own[p] += weight[i]
                held[p].add(i)
                likely[p] = likely.get(p, 0) + weight[i] * scale
    return found


def _confirmed(guess: Merges, exact: dict[tuple[str, str], int], known: set[str], beyond: int, changes: list[dict[tuple[str, str], int]]) -> Merges:
    """The guess as far as it is right, and the merge that is right in its place where it isn't.

    exact: counts of all pairs that count for more than `beyond`, and of others. A pair that isn't among them and whose symbols were there before only
    loses occurrences, so as long as the best counts for more, it is the best of all. A merge whose symbol was there before ends the round.
    """
    pairs, seen, found = _Pairs(exact), set(known), []
    for step in range(len(guess) + 1):
        best = pairs.best()
        if best is None or pairs.count[best] <= beyond:
            break
        found.append(best)
        if step == len(guess) or best != guess[step] or best[0] + best[1] in seen:
            break
        new = best[0] + best[1]
        seen.add(new)
        pairs.change({p: d for p, d in changes[step].items() if p in pairs.count or new in p or not (p[0] in known and p[1] in known)})
    return found


def train_passes(counts: DataFrame, n_merges: int, budget: int = ROUND_WORDS) -> Merges:
    """The merges by passes over the distinct words, which are split anew each time; of them `budget` at most are gathered.

    A round counts all pairs. If `budget` words hold many of the first ones, these are gathered and merged on the driver, as in train_rounds. Else the next merges are guessed from the frequent words. A second pass tells exactly by how much each step of the guess changes counts, so the
    driver can check the guess step by step against the counts of the RANKED most frequent pairs; it keeps what is right and the first correction.
    """
    some = {r["word"]: r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(min(budget, SAMPLE)).collect()}
    merges: Merges = []
    while len(merges) < n_merges:
        symbols = _Symbols(merges)
        names = sorted(symbols.names)  # by code points, as ties are decided
        place = {x: i for i, x in enumerate(names)}
        found = counts.mapInArrow(_counted(symbols.merges, [place[x] for x in symbols.names]), _SUMS).groupBy("pair").agg(F.sum("d").alias("d"), F.sum("held").alias("held"))
        ranked = found.orderBy(F.desc("d"), F.desc("pair")).limit(RANKED).collect()
        top = [(r["d"], names[r["pair"] >> 32], names[r["pair"] & 0xFFFFFFFF], r["held"]) for r in ranked]
        if not top:
            break
        left, beyond = n_merges - len(merges), top[-1][0] if len(top) == RANKED else 0
        if (k := _batch(top, budget, len(top) < RANKED)) >= min(left, GUESSED // 2):
            held = counts.mapInArrow(_holding(symbols.merges, [(symbols.number[x], symbols.number[y]) for _, x, y, _ in top[:k]]), counts.schema)
            beyond = top[k][0] if k < len(top) else 0
            merges += _learned({r["word"]: r["n"] for r in held.collect()}, merges, {(x, y): n for n, x, y, _ in top[:k]}, beyond, left)
            continue
        exact = {(x, y): n for n, x, y, _ in top}
        guess = _guess(some, merges, exact, min(left, GUESSED))
        before = set(symbols.names)
        named = [(symbols.number[x], symbols.number[y], symbols.add(x + y)) for x, y in guess]
        changed = counts.mapInArrow(_stepped(symbols.merges, named), _SUMS).groupBy("step", "pair").agg(F.sum("d").alias("d")).where("d <> 0")
        changes: list[dict[tuple[str, str], int]] = [{} for _ in guess]
        for r in changed.collect():  # pairs around GUESSED merges
            changes[r["step"]][symbols.names[r["pair"] >> 32], symbols.names[r["pair"] & 0xFFFFFFFF]] = r["d"]
        merges += _confirmed(guess, exact, before, beyond, changes)[:left]
    return merges


def train_rounds(counts: DataFrame, n_merges: int, budget: int = ROUND_WORDS) -> Merges:
    """Merges learned in rounds over an index of pairs, for any number of distinct words.

    A round takes the most frequent pairs that `budget` words at most hold together, gathers those words on the driver and merges there
    until no pair is more frequent than the first one left out. That is exact: a pair of an old round loses occurrences only, and a new one stands only
    in words that held what it was merged from, so all that can be that frequent is among the gathered words. While the first pair alone is in
    more words than that, a round learns the pairs that can't change one another's counts, without gathering any. Of more than INDEXED words the first PASSED merges are
    learned by passes, before there is an index.
    """
    counts = materialise(counts.select("word", "n").repartition(2 * counts.sparkSession.sparkContext.defaultParallelism))
    try:
        merges = train_passes(counts, min(n_merges, PASSED), budget) if counts.limit(INDEXED + 1).count() > INDEXED else []
        return _train_indexed(counts, n_merges, budget, merges) if len(merges) < n_merges else merges
    finally:
        discard(counts)


def _train_indexed(counts: DataFrame, n_merges: int, budget: int, merges: Merges) -> Merges:
    index = PairIndex(counts, merges)
    try:
        while len(index.merges) < n_merges:
            top = index.top(RANKED)
            if not top:
                break
            left, complete = n_merges - len(index.merges), len(top) < RANKED
            if k := _batch(top, budget, complete):
                some = index.words([(x, y) for _, x, y, _ in top[:k]])
                beyond = top[k][0] if k < len(top) else 0
                found = _learned({r["word"]: r["n"] for r in some.collect()}, index.merges, {(x, y): n for n, x, y, _ in top[:k]}, beyond, left)
            else:
                found = independent([t[:3] for t in top[:TOP]], len(top) < TOP)[:left]
            index.learn(found)
        return index.merges
    finally:
        index.close()


def train(docs: DataFrame, vocab_size: int, text: str = "text", driver_words: int = DRIVER_WORDS) -> tuple[Merges, dict[str, int]]:
    """Merges and vocabulary of `vocab_size` ids and one for EOT; fewer if no pair is left."""
    if vocab_size < 256:
        raise ValueError(f"vocab_size must be 256 or more, got {vocab_size}")
    counts = materialise(pretoken_counts(docs, text))
    n_merges = vocab_size - 256
    try:
        if counts.limit(driver_words + 1).count() <= driver_words:
            merges = train_words({r["word"]: r["n"] for r in counts.toLocalIterator()}, n_merges)
        else:
            merges = train_rounds(counts, n_merges, min(driver_words, ROUND_WORDS))
    finally:
        discard(counts)
    return merges, build_vocab(merges)


def build_vocab(merges: Merges) -> dict[str, int]:
    """Ids: the byte alphabet in the order of the bytes, the merges in the order learned, EOT last."""
    symbols = [*B.ALPHABET, *(left + right for left, right in merges)]
    if len(set(symbols)) < len(symbols):
        raise ValueError("two merges make the same symbol")
    return {s: i for i, s in enumerate([*symbols, EOT])}


def vocab_frame(spark, merges: Merges) -> DataFrame:
    """(id, symbol, is_special)."""
    return spark.createDataFrame([(i, s, s == EOT) for s, i in build_vocab(merges).items()], "id int, symbol string, is_special boolean")


def apply_merges(symbols: Column, merges: Merges) -> Column:
    """All merges in rank order on wrapped symbols."""
    for left, right in merges:
        symbols = B.merge(symbols, left, right)
    return symbols


def bpe_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols of one word: its lowest-ranked pair is merged, the leftmost first, until none is left.

    Places wait in a heap by rank, so a very long word costs no more than n log n.
    """
    symbols: list = [B.ALPHABET[b] for b in word.encode("utf-8")]
    waiting = [(ranks[p], i, *p) for i, p in enumerate(pairwise(symbols)) if p in ranks]
    if not waiting:
        return symbols
    heapify(waiting)
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    while waiting:
        _, i, left, right = heappop(waiting)
        j = after[i]
        if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, None
        after[i] = k = after[j]
        if k < len(symbols):
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < len(symbols) and (rank := ranks.get((symbols[a], symbols[b]))) is not None:
                heappush(waiting, (rank, a, symbols[a], symbols[b]))
    return [s for s in symbols if s is not None]


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for; new: those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class _Ids:
    """The ids of the words met so far, one after the other in one array."""

    def __init__(self, merges: Merges, remembered: int):
        self._ranks, self._vocab, self._most = {m: i for i, m in enumerate(merges)}, build_vocab(merges), remembered
        self._clear()

    def _clear(self) -> None:
        self._number = _Numbers()
        self._start, self._size, self._pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after the other, and how many each has."""
        if len(self._number) > self._most:
            self._clear()
        at = np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))
        if new := self._number.new:
            ids = [[self._vocab[s] for s in bpe_word(w, self._ranks)] for w in new]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self._start = np.append(self._start, len(self._pool) + np.cumsum(size) - size)
            self._size = np.append(self._size, size)
            self._pool = np.append(self._pool, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())))
            self._number.new = []
        n = self._size[at]
        return self._pool[np.repeat(self._start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


def _slices(batch: pa.RecordBatch, rows: int = 512):
    """The batch in slices of `rows` rows and, but for single texts beyond it, SLICE bytes of text at most."""
    upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    at = 0
    while at < batch.num_rows:
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def _parts(text: str, safe: re.Pattern):
    """The text in parts of PART characters or more, whose pretokens are those of the whole."""
    at = 0
    while len(text) - at > PART and (m := safe.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode(docs: DataFrame, merges: Merges, text: str = "text", eot: bool = False, remembered: int = REMEMBERED, then=None) -> DataFrame:
    """(doc_id, ids) of every document; null texts have null ids. EOT in a text is ordinary text.

    All stays inside a row's task: a word that all documents share costs no shuffle. then: a function of the Arrow batches of (doc_id, ids) and
    the schema of the batches that it gives in their place, in the same task.
    """
    end = build_vocab(merges)[EOT]

    def rows(doc_ids, ids, ends, null):
        if eot:
            ids = np.insert(ids, ends[~null], end)
            ends = ends + np.cumsum(~null)
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32), mask=np.append(null, False))
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    def plain(batches):
        """Without merges the ids are the text's bytes."""
        for batch in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            texts = batch.column("text").cast(pa.large_binary())
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            raw = np.frombuffer(b"".join(memoryview(x.as_buffer()) for x in texts if x.is_valid), np.uint8)
            yield rows(batch.column("doc_id"), raw.astype(np.int32), ends, texts.is_null().to_numpy(zero_copy_only=False))

    def encoded(batches):
        known, word, safe = _Ids(merges, remembered), re.compile(X.PRETOKEN), re.compile(CUT)
        for batch in (part for batch in batches for part in _slices(batch)):
            words, done, upto, found = [], 0, [], []  # upto: words up to each text's end
            for text in batch.column("text").to_pylist():
                for part in _parts(text or "", safe):
                    words += word.findall(part)
                    if len(words) >= WORDS:
                        found.append(known.of(words))
                        done, words = done + len(words), []
                upto.append(done + len(words))
            ids, sizes = zip(*found, known.of(words), strict=True)
            ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))[np.array(upto, np.int64)]
            yield rows(batch.column("doc_id"), np.concatenate(ids), ends, batch.column("text").is_null().to_numpy(zero_copy_only=False))

    after, schema = then or (lambda out: out, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    run = encoded if merges else plain
    return docs.select("doc_id", (F.make_valid_utf8(F.col(text)) if merges else F.col(text)).alias("text")).mapInArrow(lambda batches: after(run(batches)), schema)


def decode(ids: Column, merges: Merges) -> Column:
    """Text of an array of ids; malformed UTF-8 is replaced, EOT becomes its name, an unknown id raises. The ids' bytes are gathered by array operations."""
    byte = {c: i for i, c in enumerate(B.ALPHABET)}
    known = [bytes(byte[c] for c in symbol) for symbol in build_vocab(merges)]
    size = np.array([len(x) for x in known], np.int64)
    start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(known), np.uint8)

    def gathered(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        at = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(odd := at[(at < 0) | (at >= len(size))]):
            raise ValueError(f"unknown id {odd[0]}")
        n = size[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        data = pool[np.repeat(start[at] - upto[:-1], n) + np.arange(upto[-1])]
        rows = np.cumsum(np.concatenate(([0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
        out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(upto[rows].astype(np.int32)), pa.py_buffer(data)])
        return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.binary()))

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        parts = [gathered(lists.slice(k, 256)) for k in range(0, len(lists), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return F.make_valid_utf8(joined(ids).cast("string"))


def _safe() -> str:
    """A pattern of the places between two characters that no pretoken joins: neither is white space, the first is no apostrophe, and
    no class of signs holds both."""
    classes = [*X.SCRIPTS]
    rest = f"[^{X.WS}{''.join(classes)}]"
    sides = [f"(?<=[{c}])(?![{c}{X.WS}])" for c in classes]
    both = "".join(f"(?!(?<=[{c}])[{c}])" for c in classes)  # a sign of two classes joins either
    return f"(?<=[^{X.WS}'])(?=[^{X.WS}]){both}(?!(?<={rest}){rest})(?:{'|'.join([*sides, f'(?<={rest})(?!{rest})'])})"


SAFE = _safe()
CUT = f"{SAFE}|(?<=[^{X.WS}])(?=[{X.WS}])"  # or behind any character that white space follows


def safe_lengths(text: Column | str) -> Column:
    """Lengths of the pieces between all places where a text is safe to cut (X.safe_split), in order: one walk through the text."""
    return F.transform(F.split(F.col(text) if isinstance(text, str) else text, SAFE), F.length)


def safe_pieces(docs: DataFrame, target: int, text: str = "text") -> DataFrame:
    """(doc_id, piece_no, piece): long documents cut at safe places into pieces of about `target` characters, or more.

    Pretokens of the pieces are those of the whole, so one very long document can be spread over tasks.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def cut(batches):
        safe = re.compile(SAFE)
        for batch in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            rows = []
            for doc_id, whole in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = n = 0
                while m := safe.search(whole, start + target):
                    rows.append((doc_id, n, whole[start : m.start()]))
                    start, n = m.start(), n + 1
                rows.append((doc_id, n, whole[start:]))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_id").type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["doc_id", "piece_no", "piece"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece_no", T.IntegerType()), T.StructField("piece", T.StringType())])
    return docs.select("doc_id", t.alias("text")).mapInArrow(cut, schema)


class _Bundling:
    """What a run of neighbouring pieces does to the bundle that is open before it, as a function of the characters in that bundle.

    closing: for each piece that can be the first to close it, the run's characters up to and with that piece, the bundles that the
    run closes then, and the characters that it leaves open. If no piece closes it, the run only adds its `total`.
    """

    def __init__(self, closing: np.ndarray, total: int, target: int):
        self.closing, self.total, self.target = closing.reshape(-1, 3).astype(np.int64), int(total), target

    def after(self, number: int, open_: int) -> tuple[int, int]:
        """Bundles closed so far and characters open, behind the run."""
        k = int(np.searchsorted(self.closing[:, 0], self.target - open_))
        return (number + int(self.closing[k, 1]), int(self.closing[k, 2])) if k < len(self.closing) else (number, open_ + self.total)

    def then(self, other: _Bundling) -> _Bundling:
        """The function of both runs, one behind the other."""
        own = [(upto, *other.after(int(closed), int(left))) for upto, closed, left in self.closing]
        if self.total < self.target:  # some open bundles come through this run
            own += [(self.total + upto, closed, left) for upto, closed, left in other.closing]
        return _Bundling(np.array(own, np.int64), self.total + other.total, self.target)

    def rows(self) -> list[tuple[int, int, int]]:
        return [(-1, 0, self.total), *map(tuple, self.closing.tolist())]

    @classmethod
    def of(cls, rows: list[tuple[int, int, int]], target: int) -> _Bundling:
        (_, _, total), *closing = sorted(rows)
        return cls(np.array(closing, np.int64), total, target)


_FUNCTION, TREE = "key long, upto long, closed long, left long", 32


def _functions(table: pa.Table, target: int) -> list[tuple[int, _Bundling]]:
    """(key, function) of a table of functions, in the order of the keys."""
    rows: dict[int, list] = {}
    for key, *row in zip(*(table[c].to_pylist() for c in ("key", "upto", "closed", "left")), strict=True):
        rows.setdefault(key, []).append(tuple(row))
    return [(key, _Bundling.of(rows[key], target)) for key in sorted(rows)]


def _entries(functions: DataFrame, parents: list[int], target: int) -> DataFrame:
    """(key, number, open): bundles closed and characters open before each block; functions: _FUNCTION.

    Functions of neighbours are composed in a tree: `parents` divide keys into those of the next level, of which the last is one. Then the states come down it.
    """
    if not parents:  # one function, entered with nothing
        return functions.select("key").distinct().select("key", F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("open"))
    above = F.call_function("div", F.col("key"), F.lit(parents[0]).cast("long"))

    def composed(table: pa.Table) -> pa.Table:
        (_, whole), *rest = _functions(table, target)
        for _, one in rest:
            whole = whole.then(one)
        rows = list(zip(*whole.rows(), strict=True))
        return pa.table([pa.array([table["parent"][0].as_py()] * len(rows[0]), pa.int64()), *(pa.array(c, pa.int64()) for c in rows)], names=["key", "upto", "closed", "left"])

    def entered(table: pa.Table, state: pa.Table) -> pa.Table:
        at, out = (state["number"][0].as_py(), state["open"][0].as_py()), []
        for key, one in _functions(table, target):
            out.append((key, *at))
            at = one.after(*at)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "number", "open"])

    children = functions.withColumn("parent", above)
    level = materialise(children.groupBy("parent").applyInArrow(composed, _FUNCTION))
    states = _entries(level, parents[1:], target).withColumnRenamed("key", "parent")
    out = materialise(children.groupBy("parent").cogroup(states.groupBy("parent")).applyInArrow(entered, "key long, number long, open long"))
    discard(level)
    discard(states)
    return out


def bundles(pieces: DataFrame, order: str, size: Column, target: int, block_rows: int = 1 << 16) -> DataFrame:
    """pieces with bundle_no: neighbours in the order, `target` or more together; a bundle closes when that is reached.

    Greedy bundling depends on all rows before. A block of neighbours (a range partition's, `block_rows` at most) only has to tell,
    for each of its pieces that can be the first to close a bundle, how many it closes and what stays open behind it: as
    many rows as a bundle has pieces. These functions are composed in a tree, TREE neighbours at a time; then each block numbers its own pieces. `order` is a
    column without repeats.
    """
    block, room = unused("block", pieces), unused("room", pieces)

    def blocked(batches):
        from pyspark import TaskContext

        at, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            own = number + (at + np.arange(batch.num_rows)) // block_rows
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, block])

    sized = pieces.select(order, F.coalesce(size.cast("long"), F.lit(0)).alias(room)).repartitionByRange(order).sortWithinPartitions(order)
    sized = materialise(sized.mapInArrow(blocked, T.StructType([*sized.schema.fields, T.StructField(block, T.LongType())])))

    def closings(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Sums up to each piece, and for a bundle that begins at a piece the one that closes it (their number if none does)."""
        upto = np.cumsum(table.sort_by(order)[room].to_numpy())
        return upto, np.searchsorted(upto, np.concatenate(([0], upto[:-1])) + target)

    def told(table: pa.Table) -> pa.Table:
        upto, close = closings(table)
        n = len(upto)
        closed, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            if close[i] < n:
                closed[i], left[i] = closed[close[i] + 1] + 1, left[close[i] + 1]
            else:
                left[i] = upto[-1] - (upto[i - 1] if i else 0)
        first = np.arange(min(int(np.searchsorted(upto, target)) + 1, n))
        rows = _Bundling(np.stack([upto[first], closed[first + 1] + 1, left[first + 1]], axis=1), upto[-1], target).rows()
        return pa.table([pa.array(c, pa.int64()) for c in ([table[block][0].as_py()] * len(rows), *zip(*rows, strict=True))], names=["key", "upto", "closed", "left"])

    def numbered(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        upto, close = closings(table)
        step, n = np.zeros(len(upto), np.int64), len(upto)
        i = int(np.searchsorted(upto, target - table["open"][0].as_py()))
        while i < n:
            if i + 1 < n:
                step[i + 1] = 1
            i = int(close[i + 1]) if i + 1 < n else n
        return table.select([order]).append_column("bundle_no", pa.array(np.cumsum(step) + table["number"][0].as_py()))

    functions = materialise(sized.groupBy(block).applyInArrow(told, _FUNCTION))
    parents, keys = [1 << 32], ((functions.agg(F.max("key")).first()[0] or 0) >> 32) + 1  # the blocks of a partition, then partitions
    while keys > 1:
        parents.append(TREE)
        keys = -(-keys // TREE)
    entries = _entries(functions, parents, target).withColumnRenamed("key", "block")
    inside = sized.join(entries.withColumnRenamed("block", block), block)
    numbers = inside.groupBy(block).applyInArrow(numbered, T.StructType([pieces.schema[order], T.StructField("bundle_no", T.LongType())]))
    return pieces.join(numbers, order)
