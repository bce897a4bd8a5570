"""Bit-sliced Hamming comparison inside one block of fingerprints.

Plane p holds bit p of every fingerprint, 64 fingerprints to a word. A query's bit turns a plane into
the word of lanes that differ there; differences are summed by carry-save counters, one bit of every
lane's count to a word, and a block is abandoned as soon as all its lanes exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)
#: Planes between two looks at whether any lane is still within the radius.
LOOK = 16
#: Queries compared with a large block at a time.
TOGETHER = 64


def over(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, given as bits from the lowest, exceeds `radius`."""
    more, same = np.zeros_like(counts[0]), np.full_like(counts[0], FULL)
    for i in reversed(range(len(counts))):
        if radius >> i & 1:
            same &= counts[i]
        else:
            more |= same & counts[i]
            same &= ~counts[i]
    return more


def add(counts: list[np.ndarray], x: np.ndarray) -> None:
    """Add a word of ones to the counters; the highest saturates by growing a new bit."""
    for i, c in enumerate(counts):
        counts[i], x = c ^ x, c & x
        if not x.any():
            return
    counts.append(x)


def near(planes: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """Lanes within `radius` of each query. planes: bits x words; query: bits x queries x 1, each
    value all ones or zero. Result: queries x words."""
    counts = [np.zeros((query.shape[1], planes.shape[1]), np.uint64)]
    for p in range(len(planes)):
        add(counts, planes[p] ^ query[p])
        if p % LOOK == LOOK - 1 and (out := over(counts, radius)).min() == FULL:
            return ~out
    return ~over(counts, radius)


def near_own_word(planes: np.ndarray, lane: int, radius: int) -> np.ndarray:
    """For many small blocks of one word each: lanes of every word within `radius` of its `lane`."""
    counts = [np.zeros(planes.shape[1], np.uint64)]
    for p in range(len(planes)):
        bit = planes[p] >> np.uint64(lane) & ONE
        add(counts, planes[p] ^ (np.uint64(0) - bit))
        if p % LOOK == LOOK - 1 and (out := over(counts, radius)).min() == FULL:
            return ~out
    return ~over(counts, radius)


def to_planes(fps: np.ndarray, bits: int) -> np.ndarray:
    """bits x words from one-word fingerprints; lanes beyond the last are zero."""
    n, words = len(fps), -(-len(fps) // 64)
    lanes = np.zeros((words * 64, bits), np.uint8)
    lanes[:n] = np.unpackbits(fps.reshape(n, -1).view(np.uint8), axis=1, bitorder="little")[:, :bits]
    return np.packbits(lanes.T.copy(), axis=1, bitorder="little").view(np.uint64)


def query_masks(fps: np.ndarray, bits: int) -> np.ndarray:
    """bits x queries: all ones where the query's bit is set."""
    return np.where(np.unpackbits(fps.reshape(len(fps), -1).view(np.uint8), axis=1, bitorder="little")[:, :bits].T.astype(bool), FULL, np.uint64(0))


def word_blocks(fps: np.ndarray, begins: np.ndarray, sizes: np.ndarray, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes of many blocks of at most `most` rows, a word each, and the lanes that are filled."""
    lane = np.arange(most)
    real = lane < sizes[:, None]
    row = np.where(real, begins[:, None] + lane, begins[:, None])
    of = np.zeros((len(begins), 64, fps.shape[1]), np.uint64)
    of[:, :most] = fps[row]
    bit = np.unpackbits(of.view(np.uint8).reshape(len(begins), 64, -1), axis=2, bitorder="little")[:, :, :bits]
    planes = np.packbits(bit.transpose(2, 0, 1).copy(), axis=2, bitorder="little").reshape(bits, -1).view(np.uint64)
    return planes, np.bitwise_or.reduce(np.where(real, ONE << lane.astype(np.uint64), np.uint64(0)), axis=1)


def large_block(fps: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """The smallest reachable row of each row: breadth first, each row a query once."""
    n = len(fps)
    planes = to_planes(fps, bits)
    wanted = np.zeros(planes.shape[1] * 64, np.uint8)
    wanted[:n] = 1
    root = np.arange(n)
    masks = query_masks(fps, bits)
    for start in range(n):
        if not wanted[start]:
            continue
        wanted[start] = 0
        todo, at = [start], 0
        while at < len(todo):
            now = todo[at : at + TOGETHER]
            at += len(now)
            hit = np.bitwise_or.reduce(near(planes, masks[:, now, None], radius), axis=0)
            found = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little") & wanted)
            wanted[found] = 0
            root[found] = start
            todo.extend(found.tolist())
    return root


def small_blocks(fps: np.ndarray, begins: np.ndarray, sizes: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """As `large_block`, for many blocks of at most 64 rows at once: block i is rows begins[i] on."""
    root = np.arange(len(fps))
    for most in (2, 4, 8, 16, 32, 64):
        own = np.flatnonzero((sizes <= most) & (sizes > max(1, most // 2)))
        for part in np.array_split(own, max(1, len(own) // 2_000)):
            if not len(part):
                continue
            planes, filled = word_blocks(fps, begins[part], sizes[part], most, bits)
            lane = np.arange(most)
            real = lane < sizes[part][:, None]
            row = begins[part][:, None] + lane
            reach = np.stack([near_own_word(planes, k, radius) & filled for k in range(most)])
            for k in range(most):  # closure: what k reaches, all who reach k reach
                through = np.uint64(0) - (reach >> np.uint64(k) & ONE)
                reach |= reach[k] & through
            lowest = reach & (~reach + ONE)
            first = np.zeros_like(lowest, dtype=np.int64)
            for k in range(most):
                first[lowest == ONE << np.uint64(k)] = k
            got = begins[part][:, None] + first.T
            root[row[real]] = got[real]
    return root


def roots(key: np.ndarray, fps: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """For rows sorted by key: the first row that each reaches by links inside its key's block."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(edge, len(key)))
    small = sizes <= 64
    root = small_blocks(fps, edge[small], sizes[small], bits, radius)
    for a, n in zip(edge[~small], sizes[~small], strict=True):
        root[a : a + n] = a + large_block(fps[a : a + n], bits, radius)
    return root


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From batches of (key, node, fingerprint words) sorted by key: arrays that hold whole blocks."""
    kept: list[tuple] = []
    join = lambda: tuple(np.concatenate(x) for x in zip(*kept, strict=True))
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        key, node, fps = cols[0], cols[1], np.stack(cols[2:], axis=1).view(np.uint64)
        if kept and kept[-1][0][-1] != key[0]:
            yield join()
            kept = []
        change = np.flatnonzero(key[1:] != key[:-1])
        if not len(change):
            kept.append((key, node, fps))
            continue
        cut = change[-1] + 1  # the last block of the batch may go on
        kept.append((key[:cut], node[:cut], fps[:cut]))
        yield join()
        kept = [(key[cut:], node[cut:], fps[cut:])]
    if kept:
        yield join()
