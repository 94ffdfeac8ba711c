"""Exact Jaccard join of word n-gram sets by universe partition and pigeonhole.

A document's set holds 64-bit hashes of its distinct n-word shingles. Sizes fall into bands; a pair
belongs to the scheme of its smaller set's band, and its larger set is in that band or the next. A
scheme hashes the universe of shingles into segments. Sets that are similar enough differ in at most
H shingles, so if the segments' weights (1: indexed as it stands, 2: with its one-deletion
neighbourhood) exceed H, some segment agrees, at most one deletion apart for weight 2. How many
segments get weight 2 is decided by estimated cost. An empty segment says nothing and gives no
signature: a scheme has E spare segments, and a set with more empty ones is indexed again under another
hash (levels), at last by its single shingles; two sets both need that for their link to depend on it.

Signatures meet in hash buckets (see ``packed``); those held by two different sets become member
rows, unless their set shares fewer of the scheme than any linked pair must. Links are then found in two steps, both verified on the whole sets:

1. star: in each signature's group every member is compared with the group's centre, the set with
   the most partners; linked members take the centre's label;
2. rest: members with different labels are paired, in packed partner lists; the number of shared
   signatures must reach what the pigeonhole demands, then the pair is verified, in blocks of two
   parts of the sets, to which each set goes once however many partners it has there.

So a group of near copies around one original costs one comparison a member, while every pair that
is not yet known to be connected is compared. Both steps verify in blocks of two parts of the sets, so
that the partners of one set, and the members of one signature (``PAIRED`` at a time), are dealt over many
tasks. Components come from alternating star contractions.

Shingles are 64-bit hashes, as are the names of sets, and a signature's holders are told apart by 32 bits:
two shingles of a pair are taken for one with a chance of the product of its sizes over 2**64, two different
sets for equal ones with a chance of 2**-64 (of 10**10 sets, 2.7 pairs), and a pair that shares but one
signature is overlooked with a chance of 2**-32.

Defined cases: texts without words and null texts have an empty set, linked with nothing; with fewer
than n words the whole sequence is the one shingle; equal sets are one node with all their documents;
a null id takes part but is never the least; repeated rows are in one component; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from math import erfc, exp, isqrt, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import Workspace, mix64

WORDS, PERCENT = 4, 85
BUCKET_BYTES, LEVELS = 8 << 20, 5
#: Members of a signature that are paired in one piece, and rows of such pieces in one task.
PAIRED, CELL_ROWS = 512, 5000
#: Cost model: share of an ordinary text that unrelated ones may hold too, and a candidate's cost in signatures.
COMMON_SHARE, CANDIDATE_COST = 0.2, 50.0
#: Share of a band's sets that may need another level.
AGAIN_SHARE = 0.08

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
_K = np.uint64(0xA0761D6478BD642F)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse, modulo 2**64, to the powers 0 to n - 1 (n: a power of two)."""
    up, down = np.full(n, np.uint64(_BASE)), np.full(n, np.uint64(_INVERSE))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every lower-cased word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    up, down = _powers(1 << (n - 1).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_BYTE[_LOWER[data]] * up[:n])])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h ^ (ends - starts).astype(np.uint64) * _K), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct shingle hashes one behind the other, and their offsets."""
    h, doc = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    cuts = np.searchsorted(doc, np.arange(n_docs + 1))
    whole = np.full(max(0, len(h) - words + 1), np.uint64(words))
    for j in range(words):
        whole = mix64(whole * _K + h[j : j + len(whole)])
    out, sizes = [], np.zeros(n_docs, np.int64)
    for i in range(n_docs):
        a, z = cuts[i], cuts[i + 1]
        if z - a >= words:
            part = np.sort(whole[a : z - words + 1])
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        elif z > a:
            part = np.full(1, np.uint64(z - a))
            for j in range(a, z):
                part = mix64(part * _K + h[j : j + 1])
        else:
            continue
        sizes[i] = len(part)
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def set_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    sizes = np.diff(at)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix64(sets + _K))])
    return mix64((sums[at[1:]] - sums[at[:-1]]) ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def most_different(a, b, percent: int = PERCENT):
    """Shingles in which linked sets of sizes a and b can differ at most; negative if they can't be linked."""
    common = -(-percent * (a + b) // (100 + percent))
    return a + b - 2 * common


@cache
def bands(percent: int = PERCENT) -> list[tuple[int, int]]:
    """(least, largest) size of each band, up to 2**40: a set of a band and a linked larger one are at most a band apart."""
    out, low = [], 1
    while low < 2**40:
        out.append((low, max(low, low * 100 // percent)))
        low = out[-1][1] + 1
    return out


@cache
def _band_starts(percent: int = PERCENT) -> np.ndarray:
    return np.array([a for a, _ in bands(percent)])


def band_of(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.searchsorted(_band_starts(percent), n, "right") - 1


def _above(mean: float, k: int) -> float:
    """Chance that a Poisson number exceeds k; for large means by the normal distribution."""
    if mean > 100:
        return erfc((k + 0.5 - mean) / sqrt(2 * mean)) / 2
    term = total = exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return 1 - total


@cache
def scheme(band: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(segments of weight 2, segments in all, spare weight E): the cheapest of some allocations."""
    low, high = bands(percent)[band]
    h = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
    best = None
    for double in sorted({0, *((h + 1) * i // 8 for i in range(1, 5))}):
        for spare in range(0, h + 12):
            single = max(0, h + 1 + spare - 2 * double)
            m = single + double
            if not m:
                continue
            rate, empty = low / m, (1 - 1 / m) ** low
            if spare == h + 11 or _above(single * empty + 2 * double * empty * (1 + rate), spare) <= AGAIN_SHARE:
                size = single + double * (1 + rate)
                cost = size + CANDIDATE_COST * (single * COMMON_SHARE**rate + double * (1 + rate) * COMMON_SHARE ** max(0.0, rate - 1))
                if best is None or cost < best[0]:
                    best = (cost, double, m, spare)
                break
    return best[1:]


@cache
def _tables(percent: int, n_bands: int) -> tuple[np.ndarray, ...]:
    got = np.array([scheme(b, percent) for b in range(n_bands)])
    return got[:, 0], got[:, 1], got[:, 2]


def _schemes(band: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(double, segments, spare) of each band given."""
    tables = _tables(percent, (int(band.max(initial=0)) // 16 + 1) * 16)
    return tuple(x[band] for x in tables)


def signatures(sets: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """(key, set, band of the scheme, weak weight of the set at level 0) of all signatures."""
    out: list[tuple[np.ndarray, ...]] = []
    sizes = np.diff(at)
    own = band_of(np.maximum(sizes, 1), percent)
    for back in (0, 1):
        band = own - back
        todo = np.flatnonzero((sizes > 0) & (band >= 0))
        weak0 = np.zeros(len(sizes), np.int64)
        for level in range(LEVELS + 1):
            if not len(todo):
                break
            n = sizes[todo]
            ends = np.cumsum(n)
            h = sets[np.arange(ends[-1]) + np.repeat(at[todo] - (ends - n), n)]
            who = np.repeat(np.arange(len(todo)), n)
            salt = mix64((band[todo].astype(np.uint64) << np.uint64(8)) + np.uint64(level))
            if level == LEVELS:  # single shingles: any two sets with a common one meet
                out.append((mix64(h ^ salt[who]), todo[who], band[todo][who], weak0[todo][who]))
                break
            double, segments, spare = _schemes(band[todo], percent)
            value = mix64(h + _K)
            seg = ((mix64(h ^ salt[who]) >> np.uint64(32)) * segments[who].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            first = np.cumsum(segments) - segments
            slot = first[who] + seg
            total = int(segments.sum())
            sums = np.zeros(total, np.uint64)
            np.add.at(sums, slot, value)
            count = np.bincount(slot, minlength=total)
            holder = np.repeat(np.arange(len(todo)), segments)
            number = np.arange(total) - first[holder]
            name = mix64(salt[holder] + number.astype(np.uint64) * _K)
            two = number < double[holder]
            weak = np.add.reduceat(np.where(two, 2 * (count <= 1), count == 0), first)
            if not level:
                weak0[todo] = weak
            full = np.flatnonzero(count > 0)
            out.append((mix64(sums[full] ^ name[full]), todo[holder[full]], band[todo][holder[full]], weak0[todo][holder[full]]))
            less = np.flatnonzero(two[slot] & (count[slot] > 1))
            if len(less):
                s = slot[less]
                out.append((mix64((sums[s] - value[less]) ^ name[s]), todo[holder[s]], band[todo][holder[s]], weak0[todo][holder[s]]))
            todo = todo[weak > spare]
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Sets:
    """A group's distinct sets and their sorted signatures."""

    def __init__(self, group: packed.Group, words: int, percent: int):
        flat, at = shingle_sets(group.data, group.offsets, words)
        self.sizes = np.diff(at)
        names = set_ids(flat, at)
        has = np.flatnonzero(self.sizes > 0)
        self.names, pick = np.unique(names[has], return_index=True)
        keep = has[pick]
        self.doc_names = names
        n = self.sizes[keep]
        ends = np.cumsum(n)
        self.flat = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[keep] - (ends - n), n)]
        self.at = np.concatenate([[0], ends]).astype(np.int64)
        self.n = n
        key, who, band, weak = signatures(self.flat, self.at, percent)
        order = np.argsort(key)
        self.key, self.who, self.band, self.weak = key[order], who[order], band[order], weak[order]


def _send_keys(n_buckets: int, words: int, percent: int):
    def emit(group):
        s = _Sets(group, words, percent)
        low = s.key & np.uint64(0xFFFFFFFF)
        # which set holds it, told apart by bits that differ from key to key
        mark = mix64(s.names[s.who] ^ s.key) & np.uint64(0xFFFFFFFF)
        body = (low << np.uint64(32) | mark).astype("<u8")
        spans = list(packed.by_bucket(s.key, n_buckets))
        yield {"bucket": [b for b, _, _ in spans], "g": [group.g] * len(spans), "blob": [body[a:z].tobytes() for _, a, z in spans]}

    return emit


def _holders(bucket, parts):
    """For each key the number of different sets that hold it, 1 or less as 0, at most 255."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    body = np.frombuffer(b"".join(b for _, b in parts), "<u8")
    order = np.argsort(body)
    s = body[order]
    key = s >> np.uint64(32)
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.flatnonzero(new_key)
    many = np.add.reduceat(new.astype(np.int64), first)
    out = np.empty(len(body), np.uint8)
    out[order] = np.repeat(np.where(many > 1, np.minimum(many, 255), 0), np.diff(np.append(first, len(s))))
    ends = np.cumsum([len(b) // 8 for _, b in parts])
    yield {"bucket": [bucket] * len(parts), "g": [g for g, _ in parts], "blob": [squeeze.compress(out[e - len(b) // 8 : e].tobytes()) for e, (_, b) in zip(ends, parts, strict=True)]}


#: kind 0: a document (id, its set, size); 1: a member row of a shared signature; 2: a set that has such.
ROWS = "kind int, id long, set_id long, n long, sig long, score long, weak long, band long, shingles array<long>"


def enough(s: _Sets, held: np.ndarray, percent: int) -> np.ndarray:
    """Which signatures are shared by a set that shares as many of their scheme as its closest possible partner demands."""
    own = band_of(np.maximum(s.n, 1), percent)
    role = s.who * 2 + own[s.who] - s.band  # a set's place in the scheme of its own band, and of the band below
    shared = np.bincount(role[held > 0], minlength=2 * len(s.n))
    need = np.ones(2 * len(s.n), np.int64)
    high = np.array([b for _, b in bands(percent)])
    for back in (0, 1):
        some = np.flatnonzero(own - back >= 0)
        double, segments, _ = _schemes(own[some] - back, percent)
        weak = np.zeros(len(s.n), np.int64)
        mine = s.band == own[s.who] - back
        weak[s.who[mine]] = s.weak[mine]
        n = s.n[some]
        partner = n * 100 // percent if not back else np.minimum(n, high[own[some] - back])
        least = segments + double - (100 - percent) * (n + partner) // (100 + percent) - weak[some]
        need[2 * some + back] = np.maximum(1, np.where(double > 0, -(-least // 2), least))
    return (held > 0) & (shared >= need)[role]


def _members(n_buckets: int, words: int, percent: int):
    import zstandard

    def apply(group, got):
        s = _Sets(group, words, percent)
        opened = zstandard.ZstdDecompressor()
        held = np.zeros(len(s.key), np.int64)
        for b, a, z in packed.by_bucket(s.key, n_buckets):
            held[a:z] = np.frombuffer(opened.decompress(got[b], max_output_size=z - a), np.uint8)
        none = lambda n: [None] * n
        n = len(group.ids)
        yield {"kind": [0] * n, "id": [None if x else int(i) for i, x in zip(group.ids, group.lost, strict=True)], "set_id": [int(x) if c else None for x, c in zip(s.doc_names.view(np.int64), s.sizes, strict=True)], "n": s.sizes.tolist(), "sig": none(n), "score": none(n), "weak": none(n), "band": none(n), "shingles": none(n)}
        hit = np.flatnonzero(enough(s, held, percent))
        score = np.bincount(s.who, held, len(s.n)).astype(np.int64)
        who = s.who[hit]
        m = len(hit)
        yield {"kind": [1] * m, "id": none(m), "set_id": s.names[who].view(np.int64), "n": s.n[who], "sig": s.key[hit].view(np.int64), "score": score[who], "weak": s.weak[hit], "band": s.band[hit], "shingles": none(m)}
        some = np.unique(who)
        k = len(some)
        yield {"kind": [2] * k, "id": none(k), "set_id": s.names[some].view(np.int64), "n": s.n[some], "sig": none(k), "score": none(k), "weak": none(k), "band": none(k), "shingles": [s.flat[s.at[i] : s.at[i + 1]].view(np.int64) for i in some]}

    return apply


def _partners(percent: int):
    """Pairs of a bucket's members with different labels, as one packed list a set."""

    def run(table):
        import pyarrow as pa

        t = table.sort_by([("sig", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        sig, lo, hi, own, who, n, weak, band, label = (t.column(c).to_numpy() for c in ("sig", "lo", "hi", "own", "set_id", "n", "weak", "band", "label"))
        piece = np.cumsum(np.concatenate([[False], (sig[1:] != sig[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        left, right, least = [], [], []
        step, rows = 1, np.arange(len(sig) - 1)
        while len(rows):
            rows = rows[rows + step < len(sig)]
            rows = rows[piece[rows] == piece[rows + step]]
            a, b = rows, rows + step
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            ok = (label[a] != label[b]) & ((lo[a] == hi[a]) | (own[a] != own[b])) & (small * 100 >= percent * large) & (band_of(small, percent) == band[a])
            a, b = a[ok], b[ok]
            double, segments, _ = _schemes(band[a], percent)
            need = segments + double - most_different(n[a], n[b], percent) - np.minimum(weak[a], weak[b])
            left.append(np.minimum(who[a], who[b]))
            right.append(np.maximum(who[a], who[b]))
            least.append(np.where(double > 0, -(-need // 2), need))
            step += 1
        left, right, least = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, least))
        order = np.argsort(left, kind="stable")
        left, body = left[order], np.stack([right[order], least[order]], axis=1).astype("<i8")
        cut = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.zeros(0, int)
        ends = np.append(cut[1:], len(left))[: len(cut)]
        return pa.table({"set_id": pa.array(left[cut], pa.int64()), "partners": pa.array([body[a:z].tobytes() for a, z in zip(cut, ends, strict=True)], pa.binary())})

    return run


def _counted(n_parts: int):
    """Pairs that share as many signatures as linked sets must, by the parts of both sets, with the sets that they name."""

    def run(table):
        import pyarrow as pa

        parts = [np.frombuffer(x.as_py(), "<i8").reshape(-1, 2) for x in table.column("partners")]
        a = np.repeat(table.column("set_id").to_numpy(), [len(p) for p in parts])
        both = np.concatenate(parts)
        order = np.lexsort((both[:, 0], a))
        a, b, need = a[order], both[order, 0], both[order, 1]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        ok = np.diff(np.append(cut, len(a))) >= np.minimum.reduceat(need, cut)
        a, b = a[cut[ok]], b[cut[ok]]
        other = b % n_parts
        order = np.argsort(other, kind="stable")
        a, b, other = a[order], b[order], other[order]
        cut = np.flatnonzero(np.concatenate([[True], other[1:] != other[:-1]])) if len(a) else np.zeros(0, int)
        ends = np.append(cut[1:], len(a))[: len(cut)]
        return pa.table({"p": pa.array(a[cut] % n_parts, pa.int64()), "q": pa.array(other[cut], pa.int64()), "pairs": pa.array([np.stack([a[x:z], b[x:z]], axis=1).astype("<i8").tobytes() for x, z in zip(cut, ends, strict=True)], pa.binary()), "named": pa.array([np.unique(np.concatenate([a[x:z], b[x:z]])) for x, z in zip(cut, ends, strict=True)], pa.list_(pa.int64()))})

    return run


def _block_verified(percent: int):
    def run(sets, blocks):
        """sets: those that the block's pairs name, once each; blocks: one packed list of pairs."""
        import pyarrow as pa

        pairs = np.concatenate([np.frombuffer(x.as_py(), "<i8").reshape(-1, 2) for x in blocks.column("pairs")]) if blocks.num_rows else np.zeros((0, 2), np.int64)
        if not len(pairs):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        names = sets.column("set_id").to_numpy()
        shingles = sets.column("shingles").combine_chunks()
        n = shingles.value_lengths().to_numpy()
        words, local = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
        at = np.cumsum(n) - n
        order = np.argsort(names)
        a, b = (order[np.searchsorted(names[order], pairs[:, i])] for i in (0, 1))
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        mark = np.zeros(len(words), bool)
        common = np.zeros(len(a), np.int64)
        for x, z in zip(cut, np.append(cut[1:], len(a)), strict=True):
            mine = local[at[a[x]] : at[a[x]] + n[a[x]]]
            mark[mine] = True
            for i in range(x, z, 512):  # partners' sets, a bounded number at once
                who = b[i : min(z, i + 512)]
                ends = np.cumsum(n[who])
                where = np.arange(ends[-1]) + np.repeat(at[who] - (ends - n[who]), n[who])
                common[i : i + len(who)] = np.add.reduceat(mark[local[where]].astype(np.int64), ends - n[who])
            mark[mine] = False
        ok = common * 100 >= (n[a] + n[b] - common) * percent
        return pa.table({"a": pa.array(names[a[ok]], pa.int64()), "b": pa.array(names[b[ok]], pa.int64())})

    return run


def _packed_pairs(table):
    """One block's pairs and the sets that they name."""
    import pyarrow as pa

    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    return pa.table({"p": table.column("p").slice(0, 1), "q": table.column("q").slice(0, 1), "pairs": pa.array([np.stack([a, b], axis=1).astype("<i8").tobytes()], pa.binary()), "named": pa.array([np.unique(np.concatenate([a, b]))], pa.list_(pa.int64()))})


BLOCKS = "p long, q long, pairs binary, named array<long>"


def _verified(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of saved BLOCKS that are linked, on their whole sets."""
    named = blocks.select(F.col("p").alias("np"), F.col("q").alias("nq"), F.explode("named").alias("set_id")).join(sets, "set_id")
    return named.groupBy("np", "nq").cogroup(blocks.select("p", "q", "pairs").groupBy("p", "q")).applyInArrow(_block_verified(percent), "a long, b long")


def components(links: DataFrame, ws: Workspace, most_rounds: int = 60) -> DataFrame:
    """(node, least): the least node of each linked node's component, by alternating large and small stars."""
    edges = ws.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges-0")
    last = None
    for i in range(1, most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's link to a smaller one stays only if the large star of the smaller one gave it
        large = large.filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = ws.save(small, f"edges-{i}")
        ws.drop(f"edges-{i - 1}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, least_links: one row for each row.

    least_links: links of the document's set that were found and verified; a pair that was already known
    to be connected through a centre is not compared again, so the set has at least as many, and at
    least one if its component holds another set.
    """
    ws = Workspace(docs.sparkSession, "ngrams")
    groups = ws.save(packed.pack(docs, id_col, text_col), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    n_buckets = int(max(8, -(-total // BUCKET_BYTES)))
    answers = ws.save(packed.answer(packed.send(groups, _send_keys(n_buckets, words, percent), packed.BLOB), _holders), "holders")
    rows = ws.save(packed.receive(groups, answers, _members(n_buckets, words, percent), ROWS), "rows")
    ws.drop("holders")
    ws.drop("groups")
    sets = rows.filter("kind = 2").groupBy("set_id").agg(F.first("shingles").alias("shingles"))
    members = ws.save(rows.filter("kind = 1").groupBy("sig", "set_id").agg(*[F.first(c).alias(c) for c in ("n", "score", "weak", "band")]), "members")

    centre = members.groupBy("sig").agg(F.max(F.struct("score", "set_id", "n")).alias("c"))
    star = members.join(centre, "sig").filter("set_id <> c.set_id").filter(F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent)
    star = ws.save(star.select(F.least("set_id", "c.set_id").alias("a"), F.greatest("set_id", "c.set_id").alias("b"), F.col("c.set_id").alias("centre"), F.col("c.score").alias("score")).groupBy("a", "b").agg(F.max(F.struct("score", "centre")).alias("c")), "star")
    # blocks are of bounded bytes by the parts of centres; the members of one centre are dealt over n_sides blocks
    n_parts, n_sides = max(64, 4 * n_buckets), max(8, isqrt(n_buckets))
    member = F.when(F.col("a") == F.col("c.centre"), F.col("b")).otherwise(F.col("a"))
    sides = star.select(F.pmod("c.centre", F.lit(n_parts)).alias("p"), F.pmod(member, F.lit(n_sides)).alias("q"), "a", "b")
    star_blocks = ws.save(sides.groupBy("p", "q").applyInArrow(_packed_pairs, BLOCKS), "star-blocks")
    links = ws.save(_verified(star_blocks, sets, percent).join(star, ["a", "b"]), "star-links")
    label = links.select(F.when(F.col("c.centre") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("set_id"), "c").groupBy("set_id").agg(F.max("c").alias("c")).select("set_id", F.col("c.centre").alias("label"))
    # a centre that follows another keeps its own label: equal labels always mean linked to that set or being it
    label = label.join(label.select(F.col("label").alias("set_id")).distinct(), "set_id", "left_anti")

    labelled = members.join(label, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi")
    mixed = ws.save(mixed.select("sig", F.ceil(F.col("m") / PAIRED).cast("int").alias("pieces"), "m"), "mixed")
    # members of a signature are cut into pieces, which meet two by two: no task pairs more than two of them at once
    labelled = labelled.join(mixed, "sig").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("pieces").cast("long")).cast("int"))
    labelled = labelled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    n_cells = max(n_parts, (mixed.agg(F.sum(F.col("m") * F.col("pieces"))).first()[0] or 0) // CELL_ROWS)
    cells = F.pmod(F.xxhash64("sig", "lo", "hi"), F.lit(n_cells)).cast("int")
    lists = labelled.select("sig", "lo", "hi", "own", "set_id", "n", "weak", "band", "label", cells.alias("cell")).groupBy("cell").applyInArrow(_partners(percent), "set_id long, partners binary")
    # parts of the sets don't follow the number of pieces: a set goes to as many blocks as it has partners' parts
    # every set with unlinked candidates in all parts is sent 2 * n_buckets times, so parts are as large as a bucket's text
    part = F.pmod(F.col("set_id"), F.lit(n_buckets))
    blocks = lists.withColumn("cell", part).groupBy("cell").applyInArrow(_counted(n_buckets), BLOCKS)
    blocks = ws.save(blocks, "blocks")
    found = ws.save(links.select("a", "b").unionByName(_verified(blocks, sets, percent)).distinct(), "links")

    node = components(found, ws)
    degree = found.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("least_links"))
    texts = rows.filter("kind = 0").select(F.col("id").alias("doc_id"), "set_id", F.col("n").alias("n_shingles"))
    per_set = texts.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_doc"))
    per_set = per_set.join(node.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("least", F.coalesce("least", "set_id"))
    lowest = per_set.groupBy("least").agg(F.min("first_doc").alias("component_id"))
    per_set = per_set.join(lowest, "least").join(degree, "set_id", "left").select("set_id", "component_id", F.coalesce("least_links", F.lit(0)).alias("least_links"))
    out = texts.join(per_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("least_links", F.lit(0)).cast("long").alias("least_links"))
