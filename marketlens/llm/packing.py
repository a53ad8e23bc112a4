"""Packing documents into sequences of a fixed length, with few sequences.

Documents are tokenised, cut only where longer than a sequence, and packed by
best fit, longest first. A local search then moves pieces between the underfull
sequences of a group: it moves one piece, exchanges one for one, or two for
one, whenever that raises the sum of squared fills, so that small fills shrink
until a sequence is empty. The emptiest sequences are tried among each other
first, then every underfull one against all others that can take a piece of it.

Groups hold about `GROUP_PIECES` pieces, dealt by a hash, so that each is a
fair sample of all lengths; a group wastes less than about one sequence beyond
the best packing of the whole.

Defined cases: a null or empty text is the end id alone; a text of exactly the
length of a sequence stays whole; repeated rows are packed each; an empty table
gives no rows; a null doc_id is carried; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import slices, stored
from marketlens.llm.tokens import VOCABULARY, encoder

END_ID = 1
SEQUENCE = 4096
GROUP_PIECES = 20_000
# Bins the local search first tries among each other, the emptiest; then it looks at all.
SEARCHED_BINS = 48
# Changed bins that are tried directly before the lists of partners are made anew.
CHANGED_BINS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document, with the checksum of its ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * sequence)):
                    own = ids[at : at + 4 * sequence]
                    out.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes where the least room is left."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), in ascending order
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, bin_ = room.pop(at)
            bins[bin_].append(item)
        else:
            left, bin_ = capacity, len(bins)
            bins.append([item])
        if left > need:
            insort(room, (left - need, bin_))
    return bins


def _improve(a: list[int], b: list[int], size: list[int], capacity: int) -> bool:
    """Raise fill(a)^2 + fill(b)^2, where a is the fuller bin, by the best single step; False if none does."""
    fa, fb = sum(size[i] for i in a), sum(size[i] for i in b)
    room = capacity - fa
    if room == 0 or fb == 0:
        return False
    best, step = 0, None
    own = sorted((size[i], i) for i in a)
    keys = [s for s, _ in own]
    others = sorted((size[i], i) for i in b)
    gives = [(s, (i,)) for s, i in others]
    gives += [(s + t, (i, j)) for n, (s, i) in enumerate(others) for t, j in others[n + 1 :]]
    for give, items in gives:
        if give <= room and give > best:  # a move
            best, step = give, (items, None)
        at = bisect_left(keys, give - room)  # the smallest piece whose exchange still fits
        if at < len(keys) and best < give - keys[at]:
            best, step = give - keys[at], (items, own[at][1])
    for n, (s, i) in enumerate(own):  # one of b for two of a
        for t, j in own[n + 1 :]:
            at = bisect_left(others, (s + t + room + 1, -1)) - 1
            if at >= 0 and others[at][0] - s - t > best:
                best, step = others[at][0] - s - t, ((others[at][1],), (i, j))
    if step is None:
        return False
    items, back = step
    back = () if back is None else back if isinstance(back, tuple) else (back,)
    b[:] = [i for i in b if i not in items] + list(back)
    a[:] = [i for i in a if i not in back] + list(items)
    return True


class Partners:
    """Underfull bins by what they can give back for a piece: nothing, one of their pieces or two."""

    def __init__(self, bins: list[list[int]], fill: list[int], order: list[int], size: list[int], capacity: int):
        one, two = [], []
        for n in order:
            own = [size[i] for i in bins[n]]
            one += [(0, n), *((s, n) for s in set(own))]
            two += [(s, n) for s in {s + t for k, s in enumerate(own) for t in own[k + 1 :]}]
        room = capacity - np.array(fill, np.int64)
        self.most = int(room[order].max(initial=0))
        self.lists = []
        for entries in (one, two):
            back, bin_ = np.array(sorted(entries), np.int64).reshape(-1, 2).T
            self.lists.append((back, bin_, room[bin_]))

    def of(self, source: list[int], size: list[int]) -> set[int]:
        """Bins in which some piece, or two, of the source fit for what they give back."""
        own = [size[i] for i in source]
        out: set[int] = set()
        for gives, lists in ((set(own), self.lists), ({s + t for k, s in enumerate(own) for t in own[k + 1 :]}, self.lists[:1])):
            for give in gives:
                for back, bin_, room in lists:
                    lo, hi = np.searchsorted(back, (give - self.most, give))
                    out.update(bin_[lo:hi][give - back[lo:hi] <= room[lo:hi]].tolist())
        return out


def _search_all(bins: list[list[int]], fill: list[int], order: list[int], size: list[int], capacity: int) -> bool:
    """Each of the bins, from the emptiest, against all others; False if no step was found."""
    partners, changed, moved = Partners(bins, fill, order, size, capacity), set(), False
    live, total = len(order), sum(fill[n] for n in order)
    for source in order:
        again = True
        while again and fill[source]:
            again = False
            if len(changed) > CHANGED_BINS:
                partners, changed = Partners(bins, fill, [n for n in order if 0 < fill[n] < capacity], size, capacity), set()
            found = (partners.of(bins[source], size) | changed) - {source}
            for target in sorted(found, key=lambda n: (-fill[n], n)):
                while 0 < fill[source] <= fill[target] and _improve(bins[target], bins[source], size, capacity):
                    for n in (source, target):
                        fill[n] = sum(size[i] for i in bins[n])
                    changed |= {source, target}
                    again = moved = True
        if fill[source] == 0:
            live -= 1
            if total > (live - 1) * capacity:
                break  # all of them cannot do with one fewer
    return moved


def local_search(bins: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Exchange pieces between underfull bins, from the emptiest, until no bin empties any more."""
    fill = [sum(size[i] for i in b) for b in bins]
    while True:
        under = sorted((n for n, f in enumerate(fill) if 0 < f < capacity), key=lambda n: fill[n])
        if len(under) < 2 or sum(fill[n] for n in under) > (len(under) - 1) * capacity:
            break  # these bins cannot do with one fewer
        order = under[:SEARCHED_BINS]
        emptied = moved = False
        for source in order:
            for target in reversed(order):
                while source != target and 0 < fill[source] <= fill[target] and _improve(bins[target], bins[source], size, capacity):
                    moved = True
                    fill[source], fill[target] = (sum(size[i] for i in bins[n]) for n in (source, target))
            if fill[source] == 0:
                emptied = True
                break
        if not (emptied or moved or len(under) > SEARCHED_BINS and _search_all(bins, fill, under, size, capacity)):
            break
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def packed(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    cut = stored(pieces(docs, sequence, vocabulary, end_id), "pieces")
    groups = max(1, -(-cut.count() // GROUP_PIECES))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = rows["length"].tolist()
        number, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for n, items in enumerate(pack(lengths, sequence)):
            at = 0
            for i in items:
                number[i], offset[i] = n, at
                at += lengths[i]
        return rows.assign(sequence_id=number * groups + rows["bundle"], offset=offset).drop(columns="bundle")

    bundle = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    return (
        cut.withColumn("bundle", bundle)
        .groupBy("bundle")
        .applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
    )
