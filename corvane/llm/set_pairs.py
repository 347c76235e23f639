"""Sets that may be similar: parity bitmaps, an exact bound from them, and its use within candidate buckets.

A set's bitmap has a bit for each value of its elements' hashes modulo the bitmap's length: the
parity of how many elements have that value. The exclusive or of two bitmaps is the bitmap of the
elements that only one of the sets has, so it has at most as many bits as there are such elements, and
that bounds the intersection from above. The bound never rejects a pair that is similar enough,
and with two bits or more for each element it rejects nearly all that aren't. Lengths are
powers of two; a bitmap of the double length is folded by the exclusive or of its halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corvane.llm.recovery import trimmed

#: Cells are worked off together up to so many members or bytes of bitmaps, and pairs up to so many words at a time.
MEMBERS, BITMAP_BYTES, PAIR_WORDS = 1 << 15, 16 << 20, 1 << 21


def parity_bitmaps(rows: np.ndarray, hashes: np.ndarray, n: int) -> pa.Array:
    """The bitmap of each of n sets, given the row and hash of every element, each once."""
    sizes = np.bincount(rows, minlength=n)
    bits = np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(1, 2 * sizes))).astype(np.int64)))
    at = np.concatenate([[0], np.cumsum(bits)])
    place = at[rows] + ((hashes >> np.uint64(24)).astype(np.int64) & (bits[rows] - 1))
    packed = np.packbits(np.bincount(place, minlength=at[-1]).astype(np.uint8) & 1, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at // 8).astype(np.int32).tobytes()), pa.py_buffer(packed)])


class Members:
    """The sets of some cells: sizes, labels and bitmaps by length."""

    def __init__(self, size: np.ndarray, bitmaps: pa.Array):
        self.size = size
        buffer = bitmaps.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        at = np.frombuffer(bitmaps.buffers()[1], np.int32)[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1].astype(np.int64)
        self.words = (np.diff(at) // 8).astype(np.int64)
        self.place = np.zeros(len(size), np.int64)
        self.tables: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.place[own] = np.arange(len(own))
            self.tables[w] = data[at[own][:, None] + np.arange(8 * w)].view(np.uint64).reshape(len(own), w)
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def of(self, w: int, to: int) -> np.ndarray:
        if w == to:
            return self.tables[w]
        if (w, to) not in self.folded:
            table = self.of(w, 2 * to)
            self.folded[w, to] = table[:, :to] ^ table[:, to:]
        return self.folded[w, to]

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair a lower bound of how many elements only one of the two has."""
        out = np.zeros(len(x), np.int64)
        wx, wy = self.words[x], self.words[y]
        both = wx << 32 | wy
        for key in np.unique(both).tolist():
            a, b = key >> 32, key & 0xFFFFFFFF
            to = min(a, b)
            left, right, step = self.of(a, to), self.of(b, to), max(1, PAIR_WORDS // to)
            at = np.flatnonzero(both == key)
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                out[part] = np.bitwise_count(left[self.place[x[part]]] ^ right[self.place[y[part]]]).sum(axis=1, dtype=np.int64)
        return out

    def possible(self, x: np.ndarray, y: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs may share ``similarity`` per cent of the union, and the bound of those."""
        sx, sy = self.size[x], self.size[y]
        keep = np.flatnonzero(100 * np.minimum(sx, sy) >= similarity * np.maximum(sx, sy))
        differ = self.differing(x[keep], y[keep])
        total = (sx + sy)[keep]
        both = (total - differ) // 2
        ok = 100 * both >= similarity * (total - both)
        return keep[ok], differ[ok]


def possible_pairs(pairs: pa.RecordBatch, similarity: int) -> np.ndarray:
    """The rows (n_a, n_b, bits_a, bits_b) that the bound allows."""
    n = pairs.num_rows
    size = np.concatenate([pairs.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")]).astype(np.int64)
    members = Members(size, pa.concat_arrays([pairs.column("bits_a"), pairs.column("bits_b")]))
    return members.possible(np.arange(n), np.arange(n, 2 * n), similarity)[0]


def cell_pairs(cross: bool, label: np.ndarray, side: np.ndarray, chunk: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a cell's members with different labels, some at a time; in a cross cell those of different sides only."""
    n = len(label)
    rows, columns = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(n), np.arange(n))
    step = max(1, chunk // max(1, len(columns)))
    for lo in range(0, len(rows), step):
        r = rows[lo : lo + step]
        differs = label[r][:, None] != label[columns][None, :]
        if not cross:
            differs &= r[:, None] < columns[None, :]
        a, b = np.nonzero(differs)
        if len(a):
            yield r[a], columns[b]


def search_cells(similarity: int, most: int):
    """Rows (bucket, i, j, side, node, label, n, bits), sorted by cell (bucket, i, j) -> (a, b, again, bucket), a < b, that may be similar.

    Of a cell with more than ``most`` such pairs for each member, every member gives the pair of the
    least bound only, and the pairs say that the bucket is to be searched again.
    """

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        bucket, i, j, side, node, label, n = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        members = Members(n.astype(np.int64), rows.column(7))
        new = np.ones(len(node), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(node)))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # cells of a few members, all of one size at a time
        whole = (i == j)[start]
        for m in np.unique(size[(size <= 48) & whole]).tolist():
            p, q = np.triu_indices(m, 1)
            base = start[(size == m) & whole]
            step = max(1, (1 << 19) // max(1, len(p)))
            for lo in range(0, len(base), step):
                at = base[lo : lo + step]
                x, y = (at[:, None] + p).ravel(), (at[:, None] + q).ravel()
                differs = label[x] != label[y]
                x, y = x[differs], y[differs]
                keep, bound = members.possible(x, y, similarity)
                x, y = x[keep], y[keep]
                cell = np.searchsorted(start, x, side="right") - 1
                many = np.bincount(cell, minlength=len(start)) > most * size
                few = ~many[cell]
                out.append((x[few], y[few], np.zeros(few.sum(), bool)))
                if not few.all():
                    out.append(nearest(x[~few], y[~few], bound[~few]))
        for s, m in zip(start[(size > 48) | ~whole].tolist(), size[(size > 48) | ~whole].tolist(), strict=True):
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            total, over = 0, False
            for x, y in cell_pairs(bool(i[s] != j[s]), label[s : s + m], side[s : s + m]):
                keep, bound = members.possible(x + s, y + s, similarity)
                kept.append((x[keep] + s, y[keep] + s, bound))
                total += len(keep)
                if total > most * m:
                    over = True
                    x, y, bound = (np.concatenate(c) for c in zip(*kept, strict=True))
                    x, y, _, bound = nearest(x, y, bound, with_bound=True)
                    kept, total = [(x, y, bound)], 0
            if kept:
                x, y, bound = (np.concatenate(c) for c in zip(*kept, strict=True))
                out.append(nearest(x, y, bound) if over else (x, y, np.zeros(len(x), bool)))
        x, y, again = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))
        a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(again, pa.bool_()), pa.array(bucket[x], pa.int64())], ["a", "b", "again", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < MEMBERS and sum(b.nbytes for b in held) < BITMAP_BYTES:
                continue
            rows = joined(held)
            keys = [rows.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in keys]))  # the last cell may go on
            if len(last):
                cut = int(last[-1]) + 1
                yield solve(rows.slice(0, cut))
                rows = joined([rows.slice(cut)])
            held = [rows]
        if held:
            yield solve(joined(held))

    return lambda batches: trimmed(run(batches))


def nearest(x: np.ndarray, y: np.ndarray, bound: np.ndarray, with_bound: bool = False) -> tuple:
    """Of the pairs, for each member the one of the least bound."""
    both, other = np.concatenate([x, y]), np.concatenate([np.arange(len(x))] * 2)
    order = np.lexsort((other, bound[other], both))
    first = np.ones(len(order), bool)
    first[1:] = both[order][1:] != both[order][:-1]
    pick = np.unique(other[order][first])
    again = np.ones(len(pick), bool)
    return (x[pick], y[pick], again, bound[pick]) if with_bound else (x[pick], y[pick], again)


def exact_windows(code: np.ndarray, kinds: int, k: int) -> np.ndarray:
    """A number for each run of k codes below ``kinds``, equal exactly for equal runs."""
    key, space = code.astype(np.int64), max(1, kinds)
    for i in range(1, k):
        if space > (1 << 62) // max(1, kinds):
            known, key = np.unique(key, return_inverse=True)
            space = len(known)
        key = key[: max(0, len(code) - i)] * kinds + code[i:]
        space *= max(1, kinds)
    return key


def distinct_hashes(row: np.ndarray, h: np.ndarray, longest: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) in the order of rows, each once; hashes of rows with up to ``longest`` elements are told apart by their first 44 bits, so that they sort as plain numbers."""
    size = np.bincount(row)
    short = size[row] <= longest if len(size) < 1 << 20 else np.zeros(len(row), bool)
    key = np.sort(row[short].astype(np.uint64) << np.uint64(44) | h[short] >> np.uint64(20))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    rows, hashes = (key >> np.uint64(44)).astype(np.int64), key << np.uint64(20)
    if not short.all():
        more = distinct_elements(row[~short], h[~short])
        rows, hashes = np.concatenate([rows, more[0]]), np.concatenate([hashes, more[1]])
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    return rows, hashes


def distinct_elements(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) in order, each once."""
    if key.dtype == np.int64 and len(key):  # sorted as one number where both fit into one
        least = int(key.min())
        space = int(key.max()) - least + 1
        if (int(row.max()) + 1) * space < 1 << 62:
            both = np.sort(row * space + (key - least))
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
            return both // space, both % space + least
    known, code = np.unique(key, return_inverse=True)
    bits = len(known).bit_length()
    if len(row) and int(row.max()) >> (62 - bits) == 0:  # or by the rank of the key
        both = np.sort(row.astype(np.int64) << bits | code)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        return both >> bits, known[both & ((1 << bits) - 1)]
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[fresh], key[fresh]


def linked(x: np.ndarray, y: np.ndarray, at: np.ndarray, elements: np.ndarray, similarity: int) -> np.ndarray:
    """Which pairs of sets (elements[at[i]:at[i + 1]], in order) share ``similarity`` per cent of their union, and something."""
    out = np.zeros(len(x), bool)
    size = np.diff(at)
    for p in np.flatnonzero(100 * np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])).tolist():
        s, t = elements[at[x[p]] : at[x[p] + 1]], elements[at[y[p]] : at[y[p] + 1]]
        both = len(np.intersect1d(s, t, assume_unique=True))
        out[p] = both > 0 and 100 * both >= similarity * (len(s) + len(t) - both)
    return out
