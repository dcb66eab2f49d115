"""The flat token file as a data source: numbers of 16 or 32 bits one after the other, in parts at known positions.

A store is a folder of parts, each a run of positions, and meta.json (dtype, num_tokens, parts), which is written last: without it there is
no store, and parts of attempts that didn't count aren't named in it. Positions are read by byte range: a scan's splits are ranges of
positions, filters on `pos` narrow them, and drawn windows are read where they begin. Paths may be in any file system that pyarrow knows by its address.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT, META, PART, SPLIT, ROWS = "textloom_tokens", "meta.json", 1 << 24, 1 << 21, 1 << 16


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def dtype(vocab_size: int) -> str:
    return "uint16" if vocab_size <= 1 << 16 else "uint32"


@dataclass
class Store:
    """A store's metadata; parts: (first position, number, file name), in order."""

    path: str
    dtype: str
    num_tokens: int
    parts: list[tuple[int, int, str]] = field(repr=False)

    @classmethod
    def open(cls, path: str) -> Store:
        where, root = _at(path)
        if where.get_file_info(f"{root}/{META}").type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{path} is no token store")
        with where.open_input_file(f"{root}/{META}") as f:
            meta = json.loads(f.read())
        return cls(path, meta["dtype"], meta["num_tokens"], [tuple(p) for p in meta["parts"]])

    def check(self) -> Store:
        """Raise unless the parts have as many tokens as the metadata says, one after the other."""
        where, root = _at(self.path)
        width, upto = np.dtype(self.dtype).itemsize, 0
        for info, (start, n, name) in zip(where.get_file_info([f"{root}/{p[2]}" for p in self.parts]), self.parts, strict=True):
            if start != upto or info.type == fs.FileType.NotFound or info.size != n * width:
                raise ValueError(f"{self.path}: {name} hasn't the {n} tokens from {start} on that its metadata says")
            upto += n
        if upto != self.num_tokens:
            raise ValueError(f"{self.path}: {upto} tokens, its metadata says {self.num_tokens}")
        return self

    def reader(self):
        """A function of (first, until) that reads these positions; files stay open from call to call."""
        where, root = _at(self.path)
        firsts, files, kind = [p[0] for p in self.parts], {}, np.dtype(self.dtype).newbyteorder("<")

        def read(first: int, until: int) -> np.ndarray:
            found, k = [], max(bisect_right(firsts, first) - 1, 0)
            while first < until:
                start, n, name = self.parts[k]
                if name not in files:
                    if len(files) > 64:
                        files.popitem()[1].close()
                    files[name] = where.open_input_file(f"{root}/{name}")
                end = min(until, start + n)
                found.append(np.frombuffer(files[name].read_at((end - first) * kind.itemsize, (first - start) * kind.itemsize), kind))
                first, k = end, k + 1
            return np.concatenate(found) if len(found) != 1 else found[0]

        return read


@dataclass
class _Written(WriterCommitMessage):
    parts: list


class _Writer(DataSourceArrowWriter):
    """Takes rows (start, ids), range-partitioned and sorted by start, so that every task has one run of positions."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dtype, self.overwrite = options["path"], dtype(int(options.get("vocab_size", 1 << 16))), overwrite
        self.part = int(options.get("part_tokens", PART))

    def write(self, iterator):
        where, root = _at(self.path)
        where.create_dir(root, recursive=True)
        parts, out, most = [], None, np.iinfo(self.dtype).max
        try:
            for batch in iterator:
                for start, ids in zip(batch.column("start").to_pylist(), batch.column("ids"), strict=True):
                    ids = ids.values.to_numpy(zero_copy_only=False)
                    if not len(ids):
                        continue
                    if ids.min() < 0 or ids.max() > most:
                        raise ValueError(f"an id is outside of {self.dtype}")
                    if out is None or parts[-1][0] + parts[-1][1] != start or parts[-1][1] >= self.part:
                        if out is not None:
                            out.close()
                        parts.append([start, 0, f"part-{start:020d}-{uuid.uuid4().hex}.bin"])
                        out = where.open_output_stream(f"{root}/{parts[-1][2]}")
                    out.write(ids.astype(np.dtype(self.dtype).newbyteorder("<")).tobytes())
                    parts[-1][1] += len(ids)
        finally:
            if out is not None:
                out.close()
        return _Written(parts)

    def commit(self, messages) -> None:
        where, root = _at(self.path)
        parts = sorted(tuple(p) for m in messages if m is not None for p in m.parts)
        upto = 0
        for start, n, _ in parts:
            if start != upto:
                self.abort(messages)
                raise ValueError(f"the stretches leave a gap or overlap at position {min(start, upto)}")
            upto += n
        if not self.overwrite and where.get_file_info(f"{root}/{META}").type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds a store already")
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{META}.new") as f:
            f.write(json.dumps({"dtype": self.dtype, "num_tokens": upto, "parts": parts}).encode())
        where.move(f"{root}/{META}.new", f"{root}/{META}")
        own = {p[2] for p in parts} | {META}
        for info in where.get_file_info(fs.FileSelector(root)):
            if info.base_name not in own and info.base_name.startswith("part-"):
                where.delete_file(info.path)

    def abort(self, messages) -> None:
        where, root = _at(self.path)
        for _, _, name in (p for m in messages if m is not None for p in m.parts):
            if where.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                where.delete_file(f"{root}/{name}")


@dataclass
class _Range(InputPartition):
    first: int
    until: int

    def __init__(self, first: int, until: int):
        super().__init__((first, until))
        self.first, self.until = first, until


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.store = Store.open(options["path"])
        self.first, self.until = int(options.get("first", 0)), int(options.get("until", self.store.num_tokens))
        self.seq_len, self.most = int(options.get("seq_len", 0)), int(options.get("max_windows", 1 << 62))

    def pushFilters(self, filters):
        for f in filters:
            known = getattr(f, "attribute", None) == ("pos",) and not self.seq_len and getattr(f, "value", None) is not None
            if known and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, int(f.value) + isinstance(f, GreaterThan))
            if known and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.until = min(self.until, int(f.value) + (not isinstance(f, LessThan)))
            if known and isinstance(f, In) and (held := [int(v) for v in f.value if v is not None]):
                self.first, self.until = max(self.first, min(held)), min(self.until, max(held) + 1)
            if not known or isinstance(f, In) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f

    def partitions(self):
        if self.seq_len:
            n = min(self.most, max(0, (self.store.num_tokens - 1) // self.seq_len))
            step = max(1, SPLIT // self.seq_len)
            return [_Range(a, min(a + step, n)) for a in range(0, n, step)] or [_Range(0, 0)]
        until = min(self.until, self.store.num_tokens)
        return [_Range(a, min(a + SPLIT, until)) for a in range(max(self.first, 0), until, SPLIT)] or [_Range(0, 0)]

    def read(self, partition):
        read = self.store.reader()
        step = max(1, ROWS // self.seq_len) if self.seq_len else ROWS
        for a in range(partition.first, partition.until, step):
            b = min(a + step, partition.until)
            if self.seq_len:
                ids = pa.array(read(a * self.seq_len, b * self.seq_len + 1).astype(np.int32))
                ends = pa.array(np.arange(b - a + 1, dtype=np.int32) * self.seq_len)
                sides = [pa.ListArray.from_arrays(ends, ids.slice(k, (b - a) * self.seq_len)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), *sides], names=["window_id", "x", "y"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(read(a, b).astype(np.int32))], names=["pos", "token_id"])


class TokenFile(DataSource):
    """Reads (pos, token_id), or windows with the option seq_len; options first and until bound the positions."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "window_id long, x array<int>, y array<int>" if "seq_len" in self.options else "pos long, token_id int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenFile)
    return spark


def write(documents: DataFrame, path: str, vocab_size: int, part_tokens: int = PART) -> None:
    """Write placed documents (start, ids) as a store, in place of one that is there. The documents are shuffled whole."""
    _registered(documents.sparkSession)
    rows = documents.select(F.col("start").cast("long").alias("start"), F.col("ids").cast("array<int>").alias("ids")).where(F.size("ids") > 0)
    rows.repartitionByRange("start").sortWithinPartitions("start").write.format(FORMAT).option("path", path).option("vocab_size", vocab_size).option("part_tokens", part_tokens).mode("overwrite").save()


def load(spark: SparkSession, path: str, first: int | None = None, until: int | None = None) -> DataFrame:
    """(pos, token_id) of a store, or of the positions from `first` up to before `until`; raises if it isn't whole."""
    Store.open(path).check()
    scan = _registered(spark).read.format(FORMAT).option("path", path)
    for name, value in (("first", first), ("until", until)):
        scan = scan if value is None else scan.option(name, value)
    return scan.load()


def windows(spark: SparkSession, path: str, seq_len: int, max_windows: int | None = None) -> DataFrame:
    """(window_id, x, y) of a store, read as they stand: no shuffle, one token more than a split's windows hold."""
    scan = _registered(spark).read.format(FORMAT).option("path", path).option("seq_len", seq_len)
    return (scan if max_windows is None else scan.option("max_windows", max_windows)).load()


def documents(spark: SparkSession, path: str, end: int, span: int = SPLIT) -> DataFrame:
    """(doc_no, ids) of a store: the tokens between those that are `end`, without it; doc_no counts the ends before. Empty documents have no row.

    No token is shuffled: spans of positions are dealt out, a first pass counts the ends in each, and each document is read where it begins, to its end.
    """
    store = Store.open(path).check()

    def counted(batches):
        read = store.reader()
        for batch in batches:
            spans = batch.column("id").to_pylist()
            ends = [sum(int((read(a, min(a + ROWS, until)) == end).sum()) for a in range(k * span, until, ROWS)) for k in spans for until in [min((k + 1) * span, store.num_tokens)]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ends, pa.int64())], names=["id", "ends"])

    def found(first: int, until: int, no: int, read):
        """The documents that begin in the span, in order: number and tokens."""
        whole = first == 0 or read(first - 1, first)[0] == end
        held, a = [], first
        while a < store.num_tokens and (a < until or whole):
            ids = read(a, min(a + ROWS, store.num_tokens))
            at = 0
            for e in np.flatnonzero(ids == end).tolist():
                if whole:
                    held.append(ids[at:e])
                    if sum(map(len, held)):
                        yield no, np.concatenate(held)
                if a + e < until:
                    no += 1
                whole, held, at = a + e + 1 < until, [], e + 1
                if a + e + 1 >= until:
                    return
            if whole:
                held.append(ids[at:])
            a += len(ids)
        if whole and sum(map(len, held)):
            yield no, np.concatenate(held)

    def split(batches):
        read = store.reader()
        for batch in batches:
            for k, no in zip(batch.column("id").to_pylist(), batch.column("before").to_pylist(), strict=True):
                rows, size = [], 0
                for row in found(k * span, min((k + 1) * span, store.num_tokens), no, read):
                    rows.append(row)
                    size += len(row[1])
                    if size >= ROWS * 4:
                        yield _documents_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _documents_batch(rows)

    n = -(-store.num_tokens // span)
    spans = spark.range(0, n, 1, max(1, n))
    counts = [r["ends"] for r in spans.mapInArrow(counted, "id long, ends long").orderBy("id").collect()]  # a number for each span
    before = spark.createDataFrame([(k, sum_) for k, sum_ in enumerate([0, *np.cumsum(counts).tolist()][:n])], "id long, before long")
    return spans.join(F.broadcast(before), "id").mapInArrow(split, "doc_no long, ids array<int>")


def _documents_batch(rows: list) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(ids) for _, ids in rows)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([ids for _, ids in rows]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array([no for no, _ in rows], pa.int64()), ids], names=["doc_no", "ids"])


def drawn(starts: DataFrame, path: str, seq_len: int) -> DataFrame:
    """(batch_id, row, x, y) for drawn (batch_id, row, start): each window is read where it begins, and nothing else is."""
    store = Store.open(path)

    def opened(batches):
        read = store.reader()
        for batch in batches:
            start = batch.column("start").to_numpy()
            tokens = np.zeros((len(start), seq_len + 1), np.int32)
            for i in np.argsort(start, kind="stable"):
                tokens[i] = read(int(start[i]), int(start[i]) + seq_len + 1)
            ends = pa.array(np.arange(len(start) + 1, dtype=np.int32) * seq_len)
            sides = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(tokens[:, k : k + seq_len]).reshape(-1))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("batch_id"), batch.column("row"), *sides], names=["batch_id", "row", "x", "y"])

    kinds = {f.name: f.dataType.simpleString() for f in starts.schema.fields}
    return starts.select("batch_id", "row", F.col("start").cast("long").alias("start")).mapInArrow(opened, f"batch_id {kinds['batch_id']}, row {kinds['row']}, x array<int>, y array<int>")
