"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

Every byte covered by a ``length``-byte string that also starts in a document with a smaller id goes.
Suffixes are compared by their first ``length`` bytes, so a suffix's bucket may be any function of
those: here it is that of the rarest-looking gram of GRAM bytes among them, the one with the least
hash (its anchor). Runs of suffixes with one anchor travel as one piece of text of at most
2 * length - GRAM bytes. Three rounds of messages (see ``packed``):

1. groups send the hashes of their anchors, buckets answer which occur in another document;
2. groups send the pieces around those anchors, equal pieces once with their least document (equal in
   all bytes; a hash only brings them together). A bucket sorts its suffixes block by block: by the
   first 8 bytes, long ties by the ranks of a difference cover (positions i mod 7 in {0, 1, 3}, ranked
   by prefix doubling until all differ): two suffixes of any residues reach the cover by a common shift
   below 7, where their ranks decide. Pieces are laid out so that their anchors stand at multiples of
   7; equal strings then have equal residues, and most ties need one rank each. Adjacent suffixes with
   ``length`` equal bytes form a class; each gets the least document in which it starts;
3. groups apply the answers to their texts.

Defined cases: null text is empty; a row with a null id has no order: it keeps all and removes
nothing from others; rows with the same id don't count against each other; repeated rows give
repeated results; texts shorter than ``length`` are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import Workspace, mix64

LENGTH, GRAM = 50, 26
#: Difference cover modulo V: any two residues are shifted into COVER by one common shift below V.
V, COVER = 7, (0, 1, 3)
#: The common shift of each two residues; that of a residue with itself is its way to the cover.
SHIFT = tuple(tuple(min(d for d in range(V) if (a + d) % V in COVER and (b + d) % V in COVER) for b in range(V)) for a in range(V))
#: Bytes of text behind one bucket; suffixes in one block of a bucket; bytes hashed at once.
BUCKET_BYTES, BLOCK_SUFFIXES, SLICE = 4 << 20, 100_000, 1 << 20
_FAR = np.iinfo(np.int64).max
#: An answer: piece of the blob, first suffix, number of suffixes, least document.
DTYPE = [("piece", "<i4"), ("from", "u1"), ("n", "u1"), ("doc", "<i8")]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on, by doubling."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    have, width, power = data.astype(np.uint64) + np.uint64(1), 1, base
    out, taken = None, 0
    left = gram
    while True:
        if left & 1:
            out = have[:n].copy() if out is None else out * power + have[taken : taken + n]
            taken += width
        left >>= 1
        if not left:
            return mix64(out)
        have = have[:-width] * power + have[width:]
        power, width = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), 2 * width


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring suffixes with one anchor: (first suffix, number, anchor position, anchor hash).

    A suffix is one of ``length`` bytes within its document. The anchor is the leftmost gram of least hash.
    """
    firsts, counts, places, hashes = [], [], [], []
    w = length - gram + 1
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + length - 1]
        h = gram_hashes(part, gram)
        n = len(part) - length + 1
        if n <= 0:
            continue
        packed_min = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        width, low = 1, packed_min
        while 2 * width <= w:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[w - width : w - width + n]) if w > width else low[:n]
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        # suffixes that stay within their document
        inside = np.ones(n, bool)
        first_doc, last_doc = np.searchsorted(offsets, [at, at + n - 1 + length - 1], "right") - 1
        for end in offsets[first_doc + 1 : last_doc + 1] - at:  # starts too near to an end
            inside[max(0, end - length + 1) : max(0, end)] = False
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])]))
        cut_n = np.diff(np.append(cut, n))
        ok = inside[cut]
        cut, cut_n = cut[ok], cut_n[ok]
        firsts.append(cut + at)
        counts.append(cut_n)
        places.append(place[cut] + at)
        hashes.append(h[place[cut]])
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(places), np.concatenate(hashes)


class _Runs:
    """The runs of a group: all, and which of them may be shared."""

    def __init__(self, group: packed.Group):
        first, count, place, key = anchors(group.data, group.offsets)
        doc = np.searchsorted(group.offsets, first, "right") - 1
        ok = ~group.lost[doc]
        self.first, self.count, self.place, self.key, self.doc = first[ok], count[ok], place[ok], key[ok], group.ids[doc[ok]]
        self.keys, self.of = np.unique(self.key, return_inverse=True)

    def several(self) -> np.ndarray:
        """Of each distinct key, whether it occurs in several documents of the group."""
        low, high = np.full(len(self.keys), _FAR), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, self.doc)
        np.maximum.at(high, self.of, self.doc)
        return low != high

    def pieces(self, group: packed.Group, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct pieces, sorted by key: (key, first, bytes, anchor's offset, least document), and for each shared run (run, piece)."""
        run = np.flatnonzero(shared[self.of])
        first, size, inner = self.first[run], self.count[run] + LENGTH - 1, self.place[run] - self.first[run]
        h = piece_hashes(group.data, first, size)
        order = np.lexsort((h, self.key[run]))
        k, h = self.key[run][order], h[order]
        new = differing(group.data, first[order], size[order], k, h)
        at = np.flatnonzero(new)
        piece = np.empty(len(order), np.int64)
        piece[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.doc[run][order], at) if len(at) else np.zeros(0, np.int64)
        return k[at], first[order][at], size[order][at], inner[order][at], least, run, piece


def grams_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What gram_hashes gives at some positions."""
    h = np.zeros(len(at), np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + data[at + j] + np.uint64(1)
    return mix64(h)


def piece_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of pieces from those of the grams at their start, LENGTH - GRAM further and at their end, which cover them."""
    out = size.astype(np.uint64)
    for at in (first, first + LENGTH - GRAM, first + size - GRAM):
        out = mix64(out + grams_at(data, at))
    return out


def differing(data: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of pieces sorted by key and hash, whether each differs from the one before: in key, length or any byte."""
    new = np.ones(len(first), bool)
    if len(first) < 2:
        return new
    new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (size[1:] != size[:-1])
    i = np.flatnonzero(~new)
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    for off in range(0, 2 * LENGTH, 8):  # all 8-byte words, the last one up to the end
        here = i[size[i] > off]
        if not len(here):
            break
        at = np.minimum(off, size[here] - 8)
        new[here[word[first[here] + at] != word[first[here - 1] + at]]] = True
    return new


def _send_anchors(n_buckets: int):
    def emit(group):
        runs = _Runs(group)
        several = runs.several()
        low = (runs.keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        spans = list(packed.by_bucket(runs.keys, n_buckets))
        yield {"bucket": [b for b, _, _ in spans], "g": [group.g] * len(spans), "blob": [low[a:z].tobytes() + np.packbits(several[a:z]).tobytes() for _, a, z in spans]}

    return emit


def _sizes(blobs: list[bytes]) -> list[int]:
    """Number of keys: 4 bytes each and a bit each."""
    return [len(b) * 8 // 33 for b in blobs]


def _shared_anchors(bucket, parts):
    ns = _sizes([b for _, b in parts])
    keys = np.concatenate([np.frombuffer(b, "<u4", n) for (_, b), n in zip(parts, ns, strict=True)])
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, offset=4 * n), count=n) for (_, b), n in zip(parts, ns, strict=True)]).astype(bool)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    hit = np.zeros(len(k), bool)
    hit[1:] |= same
    hit[:-1] |= same
    shared = np.zeros(len(k), bool)
    shared[order] = hit
    shared |= several
    ends = np.cumsum(ns)
    yield {"bucket": [bucket] * len(parts), "g": [g for g, _ in parts], "blob": [np.packbits(shared[e - n : e]).tobytes() for e, n in zip(ends, ns, strict=True)]}


def _gather_shared(runs: _Runs, n_buckets: int, got: dict[int, bytes]) -> np.ndarray:
    shared = np.zeros(len(runs.keys), bool)
    for b, a, z in packed.by_bucket(runs.keys, n_buckets):
        shared[a:z] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=z - a).astype(bool)
    return shared


def _gather_text(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many short spans, one behind the other."""
    ends = np.cumsum(size)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
    return data[where]


def _send_pieces(n_buckets: int):
    import zstandard

    def apply(group, got):
        runs = _Runs(group)
        shared = _gather_shared(runs, n_buckets, got)
        key, first, size, inner, least, _, _ = runs.pieces(group, shared)
        squeeze = zstandard.ZstdCompressor(level=1)
        out = {"bucket": [], "g": [], "blob": []}
        for b, a, z in packed.by_bucket(key, n_buckets):
            body = least[a:z].astype("<i8").tobytes() + size[a:z].astype(np.uint8).tobytes() + inner[a:z].astype(np.uint8).tobytes() + _gather_text(group.data, first[a:z], size[a:z]).tobytes()
            out["bucket"].append(b)
            out["g"].append(group.g)
            out["blob"].append(np.int64(z - a).tobytes() + np.int64(len(body)).tobytes() + squeeze.compress(body))
        # which keys were shared, for the last round: one more row, for bucket -1
        out["bucket"].append(-1)
        out["g"].append(group.g)
        out["blob"].append(np.packbits(shared).tobytes())
        yield out

    return apply


def cover_ranks(word: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at cover positions, 1 and up, 0 elsewhere: those of all their bytes, equal ones by position.

    word: the 8 bytes from each position on. Prefix doubling from 7 bytes; what is alone with its rank is settled.
    """
    n = len(word)
    cover = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
    rank = np.zeros(2 * n + V, np.int64)
    order = cover[np.argsort(word[cover] >> np.uint64(8), kind="stable")]
    value = word[order] >> np.uint64(8)
    # a rank is the place of the first of equals, so that parting equals leaves all other ranks as they are
    where = np.arange(len(order))
    new = np.concatenate([[True], value[1:] != value[:-1]])
    width = V
    while True:
        rank[order] = np.maximum.accumulate(np.where(new, where, 0)) + 1
        alone = new & np.append(new[1:], True)
        if alone.all():
            return rank
        order, where = order[~alone], where[~alone]
        if width > n:  # equal to the end
            rank[order] = where + 1
            return rank
        group, behind = rank[order], rank[order + width]
        by = np.lexsort((order, behind, group))
        order, group, behind = order[by], group[by], behind[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])])
        width *= 2


def sort_block(text: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix numbers in the order of their bytes, and for each whether it equals the one before in LENGTH bytes.

    text ends in 8 * V spare bytes. Suffixes that stand alone with their first 8 bytes need no cover rank.
    """
    word = np.zeros(len(text) - 8, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | text[j : len(text) - 8 + j]
    order = np.argsort(word[suffixes], kind="stable")
    h = word[suffixes][order]
    same = np.zeros(len(order), bool)
    same[1:] = h[1:] == h[:-1]
    tied = same | np.append(same[1:], False)
    rank = cover_ranks(word)
    shift = np.array(SHIFT)
    who = order[tied]
    at, ht = suffixes[who], h[tied]
    group = np.cumsum(np.concatenate([[False], ht[1:] != ht[:-1]])) if len(ht) else np.zeros(0, np.int64)
    residue = at % V
    scale = np.int64(len(rank) + 1)
    place = np.zeros(len(who), np.int64)  # within the tied group
    # of one residue: by the ranks at their way to the cover
    own = np.argsort((group * V + residue) * scale + rank[at + shift[residue, residue]])
    g = (group * V + residue)[own]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    place[own] = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    # of two residues, in groups that have several: each counts the others before it, by the ranks at the common shift
    kinds = np.zeros((int(group[-1]) + 1 if len(group) else 0, V), bool)
    kinds[group, residue] = True
    several = kinds.sum(axis=1) > 1
    mixed = np.flatnonzero(several[group]) if len(group) else np.zeros(0, np.int64)
    for a in range(V):
        for b in range(a + 1, V):
            two = mixed[((residue[mixed] == a) | (residue[mixed] == b)) & (kinds[group[mixed], a] & kinds[group[mixed], b])]
            if not len(two):
                continue
            by = two[np.argsort(group[two] * scale + rank[at[two] + shift[a, b]])]
            is_a, g = residue[by] == a, group[by]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            for mine in (is_a, ~is_a):
                others = np.cumsum(~mine)
                base = np.repeat((others - ~mine)[first], np.diff(np.append(first, len(by))))
                place[by[mine]] += (others - base)[mine]
    start = np.searchsorted(group, group, "left") if len(group) else group
    sorted_who = np.empty(len(who), np.int64)
    sorted_who[start + place] = who
    order[tied] = sorted_who
    s = suffixes[order]
    equal = np.zeros(len(s), bool)
    if len(s) > 1:
        a, b = s[:-1], s[1:]
        i = np.flatnonzero(same[1:])
        for off in [*range(8, LENGTH - 8, 8), LENGTH - 8]:
            i = i[word[a[i] + off] == word[b[i] + off]]
        equal[1:][i] = True
    return order, equal


def _classes(bucket, parts):
    """Answers, for each piece, the least document of each of its suffixes where it is not the piece's own."""
    import zstandard

    if bucket < 0:
        yield {"bucket": [bucket] * len(parts), "g": [g for g, _ in parts], "blob": [b for _, b in parts]}
        return
    opened = zstandard.ZstdDecompressor()
    least, size, inner, texts, owner = [], [], [], [], []
    for i, (_, blob) in enumerate(parts):
        n, long = np.frombuffer(blob, "<i8", 2)
        body = opened.decompress(blob[16:], max_output_size=int(long))
        least.append(np.frombuffer(body, "<i8", n))
        size.append(np.frombuffer(body, np.uint8, n, 8 * n).astype(np.int64))
        inner.append(np.frombuffer(body, np.uint8, n, 9 * n).astype(np.int64))
        texts.append(np.frombuffer(body, np.uint8, offset=10 * n))
        owner.append(np.full(n, i))
    least, size, inner, texts, owner = map(np.concatenate, (least, size, inner, texts, owner))
    start = np.cumsum(size) - size
    keys = grams_at(texts, start + inner)  # cheaper to hash again than to send
    number = np.concatenate([np.arange(n) for n in np.bincount(owner, minlength=len(parts))])
    # equal pieces of different groups are one, with their least document; pieces stand sorted by key
    h = piece_hashes(texts, start, size)
    order = np.lexsort((h, keys))
    k, h = keys[order], h[order]
    new = differing(texts, start[order], size[order], k, h)
    head = np.flatnonzero(new)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    lowest_of = np.minimum.reduceat(least[order], head)
    pick, k = order[head], k[head]
    key_first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    several = np.repeat(np.diff(np.append(key_first, len(k))) > 1, np.diff(np.append(key_first, len(k))))
    # a key's only piece is its own class; of the others, answers are runs of suffixes with one least document
    alone = np.flatnonzero(~several)
    found = [np.stack([alone, np.zeros(len(alone), np.int64), size[pick[alone]] - LENGTH + 1, lowest_of[alone]])]
    rest = np.flatnonzero(several)
    bounds = np.append(np.flatnonzero(np.concatenate([[True], k[rest][1:] != k[rest][:-1]])) if len(rest) else [], len(rest)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size[pick[rest]] - LENGTH + 1)])
    a = 0
    while a < len(rest):  # blocks of whole keys, one at a time
        z = int(bounds[max(np.searchsorted(bounds, a, "right"), np.searchsorted(total[bounds], total[a] + BLOCK_SUFFIXES, "right") - 1)])
        found.append(_block(texts, start, size, inner, lowest_of, rest[a:z], pick))
        a = z
    found = np.concatenate(found, axis=1)
    # every copy of a piece gets what lies below its own least document
    by_kind = np.argsort(found[0], kind="stable")
    found = found[:, by_kind]
    cuts = np.searchsorted(found[0], np.arange(len(pick) + 1))
    many = cuts[kind + 1] - cuts[kind]
    copy = np.repeat(np.arange(len(kind)), many)
    which = np.arange(len(copy)) - np.repeat(np.cumsum(many) - many, many) + cuts[kind][copy]
    ok = found[3][which] < least[copy]
    copy, which = copy[ok], which[ok]
    rows = np.zeros(len(copy), DTYPE)
    rows["piece"], rows["from"], rows["n"], rows["doc"] = number[copy], found[1][which], found[2][which], found[3][which]
    ends = np.searchsorted(owner[copy], np.arange(len(parts) + 1))  # copies are in order of their owners
    squeeze = zstandard.ZstdCompressor(level=1)
    out = []
    for i in range(len(parts)):
        body = rows[ends[i] : ends[i + 1]].tobytes()
        out.append(np.int64(len(body)).tobytes() + squeeze.compress(body) if body else b"")
    yield {"bucket": [bucket] * len(parts), "g": [g for g, _ in parts], "blob": out}


def _block(texts, start, size, inner, lowest_of, kinds, pick) -> np.ndarray:
    """(piece, first suffix, number of suffixes, least document) of the pieces of some keys."""
    sel = pick[kinds]
    # each piece stands so that its anchor's position is a multiple of V
    base = np.cumsum(size[sel] + V) - size[sel] - V
    base += -(base + inner[sel]) % V
    text = np.zeros(int(base[-1] + size[sel][-1]) + 10 * V, np.uint8)
    text[np.repeat(base - (np.cumsum(size[sel]) - size[sel]), size[sel]) + np.arange(int(size[sel].sum()))] = _gather_text(texts, start[sel], size[sel])
    ns = size[sel] - LENGTH + 1
    piece = np.repeat(np.arange(len(sel)), ns)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(ns) - ns, ns)
    rank, equal = sort_block(text, base[piece] + offset)
    head = np.flatnonzero(~equal)
    lowest = np.empty(len(rank), np.int64)
    lowest[rank] = np.repeat(np.minimum.reduceat(lowest_of[kinds][piece][rank], head), np.diff(np.append(head, len(rank))))
    first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (lowest[1:] != lowest[:-1])]))
    return np.stack([kinds[piece[first]], offset[first], np.diff(np.append(first, len(piece))), lowest[first]])


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_start array<long>, span_end array<long>"


def _remove(n_buckets: int, keep_spans: bool):
    import zstandard

    def apply(group, got):
        opened = zstandard.ZstdDecompressor()
        runs = _Runs(group)
        covered = np.zeros(len(group.data) + 1, np.int32)
        if len(runs.keys) and -1 in got:
            shared = np.unpackbits(np.frombuffer(got[-1], np.uint8), count=len(runs.keys)).astype(bool)
            key, _, _, _, least, run, piece = runs.pieces(group, shared)
            by_piece = np.argsort(piece, kind="stable")
            cuts = np.searchsorted(piece[by_piece], np.arange(len(key) + 1))
            hits = []
            for b, a, _z in packed.by_bucket(key, n_buckets):
                blob = got.get(b)
                rows = np.frombuffer(opened.decompress(blob[8:], max_output_size=int(np.frombuffer(blob, "<i8", 1)[0])), DTYPE) if blob else np.zeros(0, DTYPE)
                hits.append(np.stack([rows["piece"].astype(np.int64) + a, rows["from"], rows["n"], rows["doc"]]))
            found = np.concatenate(hits, axis=1) if hits else np.zeros((4, 0), np.int64)
            # a piece's own least document counts against its later documents, over all of the piece
            later = np.flatnonzero(runs.doc[run] > least[piece])
            starts, ends = [runs.first[run[later]]], [runs.first[run[later]] + runs.count[run[later]] + LENGTH - 1]
            many = cuts[found[0] + 1] - cuts[found[0]]
            each = np.repeat(np.arange(found.shape[1]), many)
            which = by_piece[np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + cuts[found[0]][each]]
            ok = found[3][each] < runs.doc[run[which]]
            each, which = each[ok], which[ok]
            s = runs.first[run[which]] + found[1][each]
            starts.append(s)
            ends.append(s + found[2][each] + LENGTH - 1)
            np.add.at(covered, np.concatenate(starts), 1)
            np.add.at(covered, np.concatenate(ends), -1)
        gone = np.cumsum(covered[:-1]) > 0
        data, rows = group.data, []
        for i in range(len(group.ids)):
            a, z = group.offsets[i], group.offsets[i + 1]
            mask = gone[a:z]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            kept = data[a:z][~mask].tobytes() if len(edge) else data[a:z].tobytes()
            rows.append((None if group.lost[i] else int(group.ids[i]), int(z - a), int(mask.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge[::2].tolist() if keep_spans else None, edge[1::2].tolist() if keep_spans else None))
        yield dict(zip([c.split()[0] for c in SCHEMA.split(", ")], map(list, zip(*rows, strict=True)), strict=True))

    return apply


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_spans: bool = True) -> DataFrame:
    """The columns of SCHEMA for every row: span_start, span_end are the removed bytes' runs, in bytes of the text."""
    ws = Workspace(docs.sparkSession, "suffixes")
    groups = ws.save(packed.pack(docs, id_col, text_col), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    n_buckets = int(max(8, -(-total // BUCKET_BYTES)))
    shared = ws.save(packed.answer(packed.send(groups, _send_anchors(n_buckets), packed.BLOB), _shared_anchors), "anchors")
    pieces = packed.receive(groups, shared, _send_pieces(n_buckets), packed.BLOB)
    # rows for bucket -1 are notes of a group to itself and need no bucket; they are dealt by group
    pieces = pieces.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - F.pmod(F.col("g"), F.lit(n_buckets))).otherwise(F.col("bucket")).cast("int"))
    answers = ws.save(packed.answer(pieces, _classes), "classes")
    answers = answers.withColumn("bucket", F.greatest("bucket", F.lit(-1)))
    ws.drop("anchors")
    return packed.receive(groups, answers, _remove(n_buckets, keep_spans), SCHEMA)
