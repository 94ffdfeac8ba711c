"""Documents packed into groups of bounded bytes, and messages between groups and hash buckets.

Operators that compare all documents work in rounds: every group computes sorted 64-bit keys from
its texts and sends each bucket one blob of those that fall into the bucket; a bucket sees all
groups' keys of its range and answers each group; the group computes the same keys again and applies
the answers. What moves is packed, a key of any frequency is at most one entry a group and bucket,
and memory is that of one group or one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

GROUP_BYTES = 4 << 20
GROUP_SCHEMA = "g long, n int, size long, ids binary, lost binary, offsets binary, data binary"
BLOB = "bucket int, g long, blob binary"


@dataclass
class Group:
    g: int
    #: Ids as signed 64-bit integers; lost marks null ids.
    ids: np.ndarray
    lost: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    @staticmethod
    def read(row: dict) -> Group:
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, row["size"])) if row["size"] else b""
        return Group(row["g"], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lost"], np.uint8).astype(bool), np.frombuffer(row["offsets"], "<i8"), np.frombuffer(data, np.uint8))


def pack(docs: DataFrame, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Groups of whole documents, in the order in which they are read; a longer document is a group of its own."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        from .common import text_bytes

        squeeze = zstandard.ZstdCompressor(level=1)
        names = [c.split()[0] for c in GROUP_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        held, size, count, part = [], 0, 0, 0

        def flush():
            ids = np.concatenate([x[0] for x in held])
            lost = np.concatenate([x[1] for x in held])
            lengths = np.concatenate([x[2] for x in held])
            data = b"".join(x[3] for x in held)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            row = [part << 32 | count, len(ids), len(data), ids.astype("<i8").tobytes(), lost.astype(np.uint8).tobytes(), offsets.astype("<i8").tobytes(), squeeze.compress(data)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            data, offsets = text_bytes(batch.column(1))
            lost = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy()
            at = 0
            while at < len(ids):
                # as many rows as the group still has room for, one at least
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + group_bytes - size, "right")) - 1)
                end = min(end, at + 100_000)
                if held and offsets[end] - offsets[at] + size > group_bytes:
                    yield flush()
                    held, size, count = [], 0, count + 1
                    continue
                held.append((ids[at:end], lost[at:end], np.diff(offsets[at : end + 1]), data[offsets[at] : offsets[end]].tobytes()))
                size += int(offsets[end] - offsets[at])
                if size >= group_bytes or len(held) > 1000:
                    yield flush()
                    held, size, count = [], 0, count + 1
                at = end
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, GROUP_SCHEMA)


def groups_of(batches) -> Iterator[Group]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Group.read({k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()})


def send(groups: DataFrame, emit: Callable[[Group], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``emit`` makes of each group."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for group in groups_of(batches):
            yield from _rows(pa, names, schema, emit(group))
            give_back()

    return groups.mapInArrow(run, schema)


_KINDS = {"int": "int32", "long": "int64", "binary": "binary", "string": "string", "boolean": "bool_", "array<long>": "longs"}


def kinds(pa, schema: str) -> list:
    return [pa.list_(pa.int64()) if (k := _KINDS[c.split()[1]]) == "longs" else getattr(pa, k)() for c in schema.split(", ")]


def _rows(pa, names, schema, parts):
    """parts: dicts of equally long columns."""
    for p in parts:
        yield pa.RecordBatch.from_arrays([pa.array(p[n], k) for n, k in zip(names, kinds(pa, schema), strict=True)], names)


def answer(sent: DataFrame, reply: Callable[[int, list[tuple[int, bytes]]], Iterator[dict]], schema: str = BLOB) -> DataFrame:
    """sent: BLOB rows. reply(bucket, [(g, blob), ...] sorted by g) makes the bucket's rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(table):
        import pyarrow as pa

        table = table.sort_by("g")
        parts = list(zip(table.column("g").to_pylist(), (x.as_py() for x in table.column("blob")), strict=True))
        out = list(_rows(pa, names, schema, reply(table.column("bucket")[0].as_py(), parts)))
        del parts, table
        give_back()
        return pa.Table.from_batches(out) if out else pa.table({n: pa.array([], k) for n, k in zip(names, kinds(pa, schema), strict=True)})

    return sent.groupBy("bucket").applyInArrow(run, schema)


def receive(groups: DataFrame, answers: DataFrame, apply: Callable[[Group, dict[int, bytes]], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of ``apply``, called for each group with the answers of all buckets."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(left, right):
        import pyarrow as pa

        out = []
        if left.num_rows:
            group = Group.read({k: v[0] for k, v in left.to_pydict().items()})
            got = dict(zip(right.column("bucket").to_pylist(), (x.as_py() for x in right.column("blob")), strict=True))
            out = list(_rows(pa, names, schema, apply(group, got)))
            del group, got
            give_back()
        return pa.Table.from_batches(out) if out else pa.table({n: pa.array([], k) for n, k in zip(names, kinds(pa, schema), strict=True)})

    return groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, schema)


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the keys, so sorted keys are sorted by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of each bucket that sorted keys touch."""
    if not len(keys):
        return
    b = bucket_of(keys, n_buckets)
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for a, z in zip(cut, np.append(cut[1:], len(b)), strict=True):
        yield int(b[a]), int(a), int(z)
