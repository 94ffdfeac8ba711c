"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Texts are cut by the pattern; the distinct pieces that are not in the vocabulary as they stand go,
by length, into padded matrices of ids. Each round, every row merges its leftmost pair of lowest
rank, found by a hashed pair table, and is compacted; rows without a pair leave. Pieces longer than
``WIDEST`` bytes are merged by a heap under the same rule, since their matrix would take as many
rounds as they have bytes.

Ids come back to bytes by the vocabulary. Defined cases: null text is empty and has no ids; repeated
rows are encoded each; other columns are ignored; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back

WIDEST = 1024
#: Pieces whose ids a worker remembers, and bytes of pieces in one matrix.
REMEMBERED, MATRIX_CELLS = 150_000, 1 << 18
_NONE = np.int32(2**31 - 1)
_HASH = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.vocab[i] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() if len(t) > 1 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        keys, values = np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int32)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # open addressing: of those at a free slot one settles, the rest move on
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.cache: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id, which is its rank, of each pair; _NONE where the vocabulary has no such token."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        n, lengths = len(pieces), np.array([len(p) for p in pieces])
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        cols = np.arange(width)
        ranks = np.full((n, width), _NONE, np.int32)
        live = cols[None, :-1] + 1 < lengths[:, None]
        r, c = np.nonzero(live)
        ranks[r, c] = self.lookup(ids[r, c], ids[r, c + 1])
        out: list = [None] * n
        rows = np.arange(n)
        while len(rows):
            best = ranks.argmin(axis=1)  # the first of equal ranks
            at = np.arange(len(rows))
            merged = ranks[at, best]
            done = merged == _NONE
            for i in np.flatnonzero(done):
                out[rows[i]] = ids[i, : lengths[i]].copy()
            if done.any():
                keep = ~done
                rows, ids, ranks, lengths, best, merged = rows[keep], ids[keep], ranks[keep], lengths[keep], best[keep], merged[keep]
                if not len(rows):
                    break
                width = int(lengths.max())
                ids, ranks = ids[:, :width], ranks[:, :width]
                at = np.arange(len(rows))
            # compaction: what stands behind the pair moves up by one
            source = np.minimum(np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            lengths = lengths - 1
            ids[at, best] = merged
            ranks[at, lengths - 1] = _NONE
            for shift in (0, -1):  # the new token with its right, then with its left neighbour
                k = best + shift
                ok = (k >= 0) & (k + 1 < lengths)
                i, k = at[ok], k[ok]
                ranks[i, k] = self.lookup(ids[i, k], ids[i, k + 1])
        return out

    def _merge_heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = lambda a, b: self.ranks.get(self.vocab[ids[a]] + self.vocab[ids[b]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := rank(i, after[i])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[after[i]]))
            if before[i] >= 0 and (q := rank(before[i], i)) is not None:
                heapq.heappush(heap, (q, before[i], ids[before[i]], r))
        return np.array([ids[i] for i in range(n) if alive[i]], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        order = []
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > WIDEST:
                out[i] = self._merge_heap(p)
            else:
                order.append(i)
        order.sort(key=lambda i: len(pieces[i]))
        while order:  # buckets of like length, each of a bounded number of cells
            n = max(1, MATRIX_CELLS // max(1, len(pieces[order[0]]) * 2))
            bucket = [i for i in order[:n] if len(pieces[i]) <= 2 * len(pieces[order[0]])]
            order = order[len(bucket) :]
            for i, ids in zip(bucket, self._merge_matrix([pieces[i] for i in bucket]), strict=True):
                out[i] = ids
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; the texts' new pieces share matrices."""
        cuts = [self.find(t) for t in texts]
        pieces: dict[str, None] = {}
        for cut in cuts:
            pieces.update(dict.fromkeys(cut))
        fresh = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(fresh) > REMEMBERED:
            self.cache, fresh = {}, list(pieces)
        for p, ids in zip(fresh, self.encode_pieces([p.encode() for p in fresh]), strict=True):
            self.cache[p] = ids.astype("<u4").tobytes()
        get = self.cache.__getitem__
        return [b"".join(map(get, cut)) for cut in cuts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def _tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(read_ranks(ranks), pattern)


#: Characters of texts whose pieces are gathered before a matrix is built.
GATHERED = 1 << 20


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, null without ``keep``), ids_sha256, decoded_sha256: one row for each row.

    The rank file is read on the driver and sent to the executors: its size is that of a vocabulary.
    """
    with open(ranks_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        tok = _tokenizer(data.value, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                group, chars, first = [], 0, at
                while at < len(texts) and (not group or chars < GATHERED):
                    group.append(texts[at].as_py() or "")
                    chars += len(group[-1])
                    at += 1
                codes = tok.encode_texts(group)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, at - first), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array(codes if keep else [None] * len(codes), pa.binary()), pa.array([hashlib.sha256(c).hexdigest() for c in codes]), pa.array([hashlib.sha256(tok.decode(c)).hexdigest() for c in codes])],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )
        tok.cache = {}  # the worker lives on, beside the executor's heap
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def encode_documents(spark: SparkSession, docs: DataFrame, keep: bool = False) -> DataFrame:
    """``encode`` with the installed 50k byte-level vocabulary."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)
