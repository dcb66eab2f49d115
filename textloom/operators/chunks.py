"""Documents that arrive in chunks, cut anywhere: their pretokens and ids are those of the whole.

Between two characters that no pretoken joins (`tokenizer.SAFE`), and behind any character that white space follows, a text can be cut
without changing a pretoken, whatever follows. What a chunk holds between its first and its last such place doesn't depend on other chunks. The
rest of it, its head and tail, is joined with the tail before and the head behind, over chunks that have no such place: seams.
In batch form neighbouring chunks that a task meets one after the other are put together first (runs of RUN bytes or little more), runs are
handled apart and seams found by running sums, so the chunks of one very long document are spread over tasks; in streaming form a document's
open tail is its state.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..sources.shared import materialise
from . import tokenizer
from .order import running_before

RUN, WINDOW = 1 << 18, 32  # bytes; characters


def cut(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, chunk): every text in chunks of `size` characters; an empty or null text is one empty chunk."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return docs.select("doc_id", found.alias("found")).select("doc_id", F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.lit("")))).alias("chunk_no", "chunk"))


def _first(place: re.Pattern, text: str) -> int | None:
    """The first place in a text."""
    m = place.search(text)
    return m.start() if m else None


def _last(place: re.Pattern, text: str) -> int | None:
    """The last place in a text, looked for from the end in windows that grow: a place depends on the characters beside it."""
    end, window = len(text), WINDOW
    while end > 0:
        start, last = max(0, end - window), None
        for m in place.finditer(text, start, end):
            last = m.start()
        if last is not None:
            return last
        end, window = start, 2 * window
    return None


def _runs(batches):
    """(doc_id, first chunk_no, text) of neighbouring chunks of a document that follow each other in the rows, a run ended at RUN bytes."""
    doc = first = due = None
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, numbers, chunk = batch.column("doc_id"), batch.column("chunk_no").to_numpy(), batch.column("chunk").cast(pa.large_binary())
        coded = ids.dictionary_encode(null_encoding="encode") if not pa.types.is_nested(ids.type) else None
        same = coded.indices.to_numpy() if coded is not None else np.arange(len(ids))
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = memoryview(chunk.buffers()[2] or b"")
        starts = np.concatenate(([0], np.flatnonzero((same[1:] != same[:-1]) | (numbers[1:] != numbers[:-1] + 1)) + 1, [len(same)])).tolist()
        names, numbers = pc.take(ids, pa.array(starts[:-1])).to_pylist(), numbers.tolist()
        for name, a, b in zip(names, starts, starts[1:], strict=False):
            if first is None or name != doc or numbers[a] != due or size >= RUN:
                if first is not None:
                    yield doc, first, b"".join(held).decode()
                doc, first, held, size = name, numbers[a], [], 0
            held.append(bytes(data[offsets[a] : offsets[b]]))
            size, due = size + len(held[-1]), numbers[b - 1] + 1
    if first is not None:
        yield doc, first, b"".join(held).decode()


def pieces(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, part, piece): texts whose pretokens, in the order of chunk_no and part, are the document's.

    chunks: (doc_id, chunk_no, chunk) in any order; each number once in a document, null chunks are empty. Part 0 lies inside the chunk or the
    run of neighbours that it begins, part 1 is the seam behind it.
    """
    kind = chunks.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("chunk_no", T.LongType()), T.StructField("open", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("head", "inside", "tail")]])

    def opened(batches):
        place, names = re.compile(tokenizer.CUT), schema.names
        runs, rows, size = _runs(batches), [], 0

        def record():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for doc, no, text in runs:
            first = _first(place, text)
            last = None if first is None else _last(place, text)
            rows.append((doc, no, 0, text, "", "") if last is None else (doc, no, 1, text[:first], text[first:last], text[last:]))
            size += len(text)
            if size >= 4 * RUN or len(rows) >= 1024:
                yield record()
                rows, size = [], 0
        if rows:
            yield record()

    types = to_arrow_schema(schema).types
    ends = materialise(chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.coalesce("chunk", F.lit("")).alias("chunk")).mapInArrow(opened, schema), "zstd")
    narrow = running_before(ends.select("doc_id", "chunk_no", "open", "head", "tail"), ["doc_id", "chunk_no"], {"seam": "open"})
    # a head closes the seam that is open before it, a tail opens the next one
    sides = F.array(F.struct(F.col("seam"), F.lit(0).alias("side"), F.col("head").alias("text")), F.struct((F.col("seam") + F.col("open")).alias("seam"), F.lit(1).alias("side"), F.col("tail").alias("text")))
    met = narrow.select("doc_id", "chunk_no", F.explode(sides).alias("s")).select("doc_id", "chunk_no", "s.*").where("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "side", "text"))), lambda x: x["text"]), "")
    seams = met.groupBy("doc_id", "seam").agg(F.min(F.struct("chunk_no", "side")).alias("from"), joined.alias("piece"))
    # a seam that begins with a head is the one at a document's start
    seams = seams.select("doc_id", F.when(F.col("from.side") == 1, F.col("from.chunk_no")).otherwise(-1).cast("long").alias("chunk_no"), F.lit(1).alias("part"), "piece")
    return ends.where("inside <> ''").select("doc_id", "chunk_no", F.lit(0).alias("part"), F.col("inside").alias("piece")).unionByName(seams)


def pretokens(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, part, words): the pretokens of every piece."""
    return pieces(chunks).select("doc_id", "chunk_no", "part", X.pretokens("piece").alias("words"))


def encode(chunks: DataFrame, merges: tokenizer.Merges, then=None) -> DataFrame:
    """(doc_id, chunk_no, part, ids): the ids of every piece, in that order those of the document. then: as of tokenizer.encode, doc_id a struct of these three."""
    key = F.struct("doc_id", "chunk_no", "part").alias("doc_id")
    out = tokenizer.encode(pieces(chunks).select(key, F.col("piece").alias("text")), merges, then=then)
    return out.select("doc_id.*", *out.columns[1:])


def stream_pretokens(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, words) of a stream of (key, chunk_no, chunk, last): each micro-batch gives the pretokens that are certain by then.

    State: the number of the chunk that is due, the open tail, and chunks that came too early. The chunk marked `last` closes its document, after
    which the state goes; a chunk that was there before is left out. Write in append mode.
    """
    kind = chunks.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("words", T.ArrayType(T.StringType()))])
    place, token = re.compile(tokenizer.CUT), re.compile(X.PRETOKEN)

    def advanced(group, frames, state):
        import pandas as pd

        due, tail, early = state.get if state.exists else (0, "", "{}")
        waiting = {int(k): v for k, v in json.loads(early).items()}
        for f in frames:
            for no, chunk, last in zip(f["chunk_no"], f["chunk"], f["last"], strict=True):
                if no >= due:
                    waiting[int(no)] = [chunk or "", bool(last)]
        words, closed = [], False
        while not closed and due in waiting:
            chunk, closed = waiting.pop(due)
            tail, due = tail + chunk, due + 1
        at = len(tail) if closed else _last(place, tail) or 0
        words, tail = [m.group() for m in token.finditer(tail[:at])], tail[at:]
        if closed:
            state.remove()
        else:
            state.update((due, tail, json.dumps(waiting)))
        if words:
            yield pd.DataFrame({key: [group[0]], "words": [words]})

    return chunks.select(key, "chunk_no", "chunk", "last").groupBy(key).applyInPandasWithState(advanced, out, "due long, tail string, early string", "append", "NoTimeout")
