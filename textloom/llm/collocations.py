"""Phrases that stand together more often than their parts: mined from all n-grams, for each language.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and into words at blanks. All 1..max_n-grams of the
pieces become rows (lang, phrase, n), added up inside each Arrow batch before they leave the worker, so that a phrase that
all documents hold is one row for each batch, and then hash-aggregated over all documents. Only grams of `least` occurrences
can be candidates or parts of one: the rest go right after the sum. A row with the empty phrase carries a language's words.
Grams of three words and more hold no fewer pairs of neighbours than they occur, so they are exploded after the pairs are counted, and
those with a pair that isn't frequent don't become rows. Frequent pairs are told by a Bloom filter of BITS bits (16 MB): full or not, it lets all
frequent ones through, so it spares rows and decides nothing.

A candidate has 2 to max_n words. Each cut of it into a first part and a rest meets the counts of both by equi-joins, spread by salts;
its score is floor(SCALE * f * f / (first * rest)) in decimals of 38 digits: exact up to 10^16 occurrences, as f is at most either part's.
The lowest-scoring cut counts, of equals the one with the shortest first part. A candidate whose words stand inside a longer one of at least
`share` of its occurrences goes; an extension by one word is enough to look at, since those between have no fewer occurrences than the
longest. The rest are ranked in two windows: inside (lang, salt), and over the `top` of each salt.

Defined cases: null and empty texts have no words; null languages are UNKNOWN, as documents that bear that name; repeated rows count each;
a language without candidates, or an empty table, gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, materialise, parts, salt, tidy

MAX_N, LEAST, SHARE, TOP, SCALE = 3, 10, 50, 2000, 1_000_000  # SHARE in per cent
UNKNOWN, ROWS, TEXT = "und", 1 << 16, 12 << 20
BITS, PROBES, _P = 1 << 27, 3, np.uint64(0x9E3779B97F4A7C15)

_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_GRAMS = "lang string, phrase string, n long"


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False)


class Pairs:
    """A Bloom filter of (language, word, next word): a bounded number of bits, whatever it holds."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(lang: np.ndarray, first: np.ndarray, second: np.ndarray, bits: int):
        """Of each pair, PROBES places of `bits`, a power of two."""
        h = (lang * _P + first) * _P + second
        for _ in range(PROBES):
            h = (h ^ (h >> np.uint64(32))) * _P
            yield h >> np.uint64(65 - bits.bit_length())

    def may_hold(self, lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.ones(len(first), bool)
        for at in self.places(lang, first, second, 64 * len(self.bits)):
            out &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's number in them (-1: the end of a piece), and each word's text."""
    cut = pc.split_pattern(pa.array([t.translate(_PLAIN).replace(b"\n", b" \n ") + b" \n" for t in texts], pa.large_binary()), " ")
    flat = cut.flatten().dictionary_encode()
    words = flat.dictionary
    number = flat.indices.to_numpy().astype(np.int64)
    for sign, place in ((b"", -2), (b"\n", -1)):
        if (at := pc.index(words, pa.scalar(sign, words.type)).as_py()) >= 0:
            number[number == at] = place
    held = number != -2
    return words, number[held], np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy())[held]


def counted(texts: list[bytes], langs: list[str], lengths: range = range(1, MAX_N + 1), pairs: Pairs | None = None) -> list[tuple[pa.Array, pa.Array, np.ndarray]]:
    """For each length the different grams of the texts: (languages, phrases, numbers); before those of one word the empty phrase
    with all words. With `pairs`, only grams of which all neighbouring words may be in them."""
    words, number, text = _tokens(texts)
    names, own = np.unique(np.array(langs, object), return_inverse=True) if langs else (np.zeros(0, object), np.zeros(0, np.int64))
    size = max(len(words), 1)
    here = np.flatnonzero(number >= 0)  # where a gram begins
    inside = (number[:-1] >= 0) & (number[1:] >= 0)  # whether a word and the next are neighbours
    if pairs is not None:
        at = np.flatnonzero(inside)
        hashed = _hashes(words)
        inside[at] = pairs.may_hold(_hashes(pa.array(names, pa.binary()))[own[text[at]]], hashed[number[at]], hashed[number[at + 1]])
        here = np.flatnonzero(inside)
    code, found = pd.factorize(own[text[here]] * size + number[here])
    lang, last = found // size, found % size
    phrases, n, out = words.take(pa.array(last)), np.bincount(code, minlength=len(found)), []
    if 1 in lengths:
        all_words = np.bincount(lang, n, len(names)).astype(np.int64)
        some = np.flatnonzero(all_words)
        out += [(pa.array(names[some], pa.string()), pa.array([b""] * len(some), phrases.type), all_words[some]), (pa.array(names[lang], pa.string()), phrases, n)]
    for k in range(2, lengths.stop):
        reach = here + (k - 2) < len(inside)
        reach[reach] = inside[here[reach] + (k - 2)]
        here, code = here[reach], code[reach]
        code, found = pd.factorize(code * size + number[here + (k - 1)])
        shorter = found // size
        lang, phrases = lang[shorter], pc.binary_join_element_wise(phrases.take(pa.array(shorter)), words.take(pa.array(found % size)), pa.scalar(b" ", words.type))
        if k in lengths:
            out.append((pa.array(names[lang], pa.string()), phrases, np.bincount(code, minlength=len(found))))
    return out


def _exploded(lengths: range, pairs=None):
    def exploded(batches):
        for batch in batches:
            for part in parts(batch, batch.num_rows, TEXT):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for lang, phrase, n in counted(texts, part.column("lang").to_pylist(), lengths, pairs and Pairs(pairs.value)):
                    n = pa.array(n.astype(np.int64))
                    for at in range(0, len(lang), ROWS):
                        columns = [x.slice(at, ROWS) for x in (lang, phrase, n)]
                        columns[1] = columns[1].cast(pa.large_string()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])

    return exploded


def grams(docs: DataFrame, lengths: range = range(1, MAX_N + 1), pairs=None) -> DataFrame:
    """(lang, phrase, n): all grams of these lengths with their occurrences and, with those of one word, the empty phrase with
    a language's words. pairs: the broadcast bits of Pairs."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = own.mapInArrow(tidy(_exploded(lengths, pairs)), _GRAMS)
    return rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))  # added up already before the shuffle


def _pairs_of(frequent: DataFrame, size: int) -> np.ndarray:
    """The bits of all frequent phrases of two words: size / 64 numbers at most reach the driver."""

    def marked(batches):
        for batch in batches:
            both = pc.split_pattern(batch.column("phrase").cast(pa.binary()), " ")
            hashed = [_hashes(batch.column("lang").cast(pa.binary())), *(_hashes(pc.list_element(both, k)) for k in (0, 1))]
            at = np.unique(np.concatenate(list(Pairs.places(*hashed, size))))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["cell", "bits"])

    two = frequent.where(F.size(F.split("phrase", " ")) == 2).select("lang", "phrase")
    cells = two.mapInArrow(tidy(marked), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size >> 6, np.uint64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return bits


def _score(f: Column, first: Column, rest: Column) -> Column:
    exact = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * exact(f) * exact(f), exact(first) * exact(rest))


def mine(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases; a, l and r count the phrase and the parts of its cut, n all words."""
    spark = docs.sparkSession
    every = materialise(grams(docs, range(1, min(max_n, 2) + 1)).where((F.col("n") >= least) | (F.col("phrase") == "")))
    if max_n > 2:
        pairs = spark.sparkContext.broadcast(_pairs_of(every, BITS))  # BITS / 8 bytes
        every = every.unionByName(materialise(grams(docs, range(3, max_n + 1), pairs).where(F.col("n") >= least)))
        pairs.unpersist()
    frequent = every.where(F.col("phrase") != "").withColumnRenamed("n", "f")
    words = every.where(F.col("phrase") == "").select("lang", "n")
    split = F.split("phrase", " ")
    candidates = frequent.select("lang", "phrase", F.col("f").alias("a"), split.alias("w")).where(F.size("w") > 1)
    joined = lambda w, start, size: F.array_join(F.slice(w, start, size), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), joined(F.col("w"), F.lit(1), k).alias("first"), joined(F.col("w"), k + 1, F.size("w") - k).alias("rest")))
    rows = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    met = looked_up(looked_up(rows, part("first", "l"), ["lang", "first"], "phrase"), part("rest", "r"), ["lang", "rest"], "phrase")
    scored = met.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    inner = F.array(joined(F.col("w"), F.lit(1), F.size("w") - 1), joined(F.col("w"), F.lit(2), F.size("w") - 1))
    longer = candidates.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own, ext = best.alias("own"), longer.alias("ext")
    inside = (F.col("own.lang") == F.col("ext.lang")) & (F.col("own.phrase") == F.col("ext.phrase")) & (F.col("ext.longer") * 100 >= F.col("own.a") * share)
    kept = own.join(ext, inside, "left_anti").withColumn("salt", salt("phrase"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    few = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # `top` rows of each salt
    return few.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The query's rows in SQL, for phrases of 2 or 3 words.
ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece
  FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM worded
), counts AS (SELECT lang, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY lang, phrase),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cand AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE f >= {LEAST} AND contains(phrase, ' ')),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * a * a) // (l.f * r.f) AS score FROM cuts c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM cand WHERE len(w) = 3) x WHERE x.lang = b.lang AND x.part = b.phrase AND 100 * x.a >= {SHARE} * b.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN words USING (lang) WHERE rank <= {TOP}
"""
