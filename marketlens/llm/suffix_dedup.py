"""Removal of byte strings that start more than once in a corpus.

Every byte covered by a `WINDOW`-byte string that also starts elsewhere is
found, within and between documents, judged on the input.

1. Each window has one anchor: the leftmost `GRAM`-byte string in it of the
   smallest hash. Equal windows have equal anchors at equal offsets. Neighbouring
   windows share anchors, so a document gives one row per run of windows, about
   one in 70 bytes: the anchor's hash, the run, and a hash of its bytes.
2. Anchors that occur once need no more work. Runs equal in all bytes repeat.
3. Where one anchor stands in runs that differ, one run of each kind is fetched.
   Within a group, what follows and what precedes the anchor are sorted by
   deep-shallow sorting; two runs share the window at an offset if their common
   prefixes reach far enough on both sides, so equal windows are the cells of
   both orders' prefix classes.
4. A group of more than `HOT_RUNS` kinds is not sent to one task. Its windows are
   halved by the offset of the anchor: all windows of a half hold the same stretch
   before and after the anchor, and fall into smaller groups by it, of runs cut
   to what the half needs, where many become equal. Groups still too large are
   halved again, at most eight times; the others are sorted like any group.

Defined cases: a null text has no bytes; a text shorter than the window, or an
empty one, loses nothing; all rows count as documents, also such that repeat a
doc_id or a whole row, and a null doc_id is carried; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import slices, stored
from marketlens.llm.deep_shallow import deep_shallow_sort
from marketlens.llm.shingles import mixed

WINDOW = 200
GRAM = 64
SPAN = WINDOW - GRAM  # offsets of an anchor in its window: 0 to SPAN
CHUNK_BITS = 20
HOT_RUNS = 2000
BATCH_RUNS = 40_000
HALF = ["mark", "print", "lo", "hi", "n", "key", "start", "windows", "offset", "run"]
FACTOR = 0xBF58476D1CE4E5B9
_TABLE = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(FACTOR, n, 1 << 64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    hashed, size = _TABLE[data], 1
    while size < GRAM:
        hashed = hashed[:-size] * _power(size) + hashed[size:]
        size *= 2
    return mixed(hashed)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbours."""
    n, size = len(values) - width + 1, 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: number of the text, first window, windows, offset of the anchor, two hashes."""
    out: list[tuple[np.ndarray, ...]] = []
    limit = 1 << CHUNK_BITS
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        data = np.frombuffer(b"".join(part for _, _, part in held), np.uint8)
        lengths = np.array([len(part) for _, _, part in held])
        ends = np.cumsum(lengths)
        part_of = np.repeat(np.arange(len(held)), lengths)
        grams = _gram_hashes(data)
        low = np.uint64(limit - 1)
        anchor = (_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), SPAN + 1) & low).astype(np.int64)
        windows = np.arange(len(anchor))
        part = part_of[: len(anchor)]
        inside = windows + WINDOW <= ends[part]
        windows, anchor, part = windows[inside], anchor[inside], part[inside]
        new = np.ones(len(windows), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(windows)])
        start, anchor, part = windows[first], anchor[first], part[first]
        length = count + WINDOW - 1
        span = mixed(count.astype(np.uint64) * np.uint64(1 << 32) + (anchor - start).astype(np.uint64))
        for i in range(-(-(WINDOW + SPAN) // GRAM)):  # grams that cover the run
            span = mixed(span * _power(3) + grams[start + np.minimum(GRAM * i, length - GRAM)])
        begin = np.array([at for _, at, _ in held]) - (ends - lengths)
        number = np.array([n for n, _, _ in held])
        out.append((number[part], start + begin[part], count, anchor - start, grams[anchor], span))
        held.clear()

    for n, text in enumerate(texts):
        for at in range(0, len(text) - WINDOW + 1, limit - WINDOW):
            part = text[at : at + limit - 1]  # parts overlap so that every window is in exactly one
            if size + len(part) >= limit:
                flush()
                size = 0
            held.append((n, at, part))
            size += len(part)
    if held:
        flush()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def occurrences(rows: DataFrame) -> DataFrame:
    """Runs of all documents; rows: (key, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key = batch.column(0).to_numpy()
            number, start, count, offset, anchor, span = runs([_bytes(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[number]), pa.array(start.astype(np.int64)), pa.array(count.astype(np.int32)),
                    pa.array(offset.astype(np.int32)), pa.array(anchor.astype(np.uint64).view(np.int64)),
                    pa.array(span.astype(np.uint64).view(np.int64)),
                ],
                ["key", "start", "windows", "offset", "anchor", "span"],
            )

    return rows.mapInArrow(scan, "key long, start long, windows int, offset int, anchor long, span long")


VARIANT = "anchor long, span long, n long, key long, start long, windows int, offset int, run binary"


def fetched(kinds: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes of one run of each kind."""
    wanted = kinds.groupBy("key").agg(F.collect_list(F.struct("anchor", "span", "n", "start", "windows", "offset")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "span", "n", "start", "windows", "offset")
        for batch in slices(batches, 64):
            lists = batch.column(2)
            texts = [_bytes(t) for t in batch.column(1).to_pylist()]
            per = np.diff(lists.offsets.to_numpy())
            own = lists.flatten()
            columns = {n: own.field(n) for n in names}
            which = np.repeat(np.arange(len(texts)), per)
            data = [
                texts[i][s : s + w + WINDOW - 1]
                for i, s, w in zip(which.tolist(), columns["start"].to_pylist(), columns["windows"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    columns["anchor"], columns["span"], columns["n"], pa.array(batch.column(0).to_numpy()[which]),
                    columns["start"], columns["windows"], columns["offset"], pa.array(data, pa.binary()),
                ],
                ["anchor", "span", "n", "key", "start", "windows", "offset", "run"],
            )

    return rows.join(wanted, "key").select("key", "text", "runs").mapInArrow(cut, VARIANT)


def repeated_windows(group: np.ndarray, n: np.ndarray, windows: np.ndarray, offset: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Which windows (row by run, column by offset of the anchor) stand in several runs of a group, counting each run n times."""
    after = [d[o + GRAM :] for d, o in zip(data, offset.tolist(), strict=True)]
    before = [d[:o][::-1] for d, o in zip(data, offset.tolist(), strict=True)]
    after_order, after_common = deep_shallow_sort(after, group)
    before_order, before_common = deep_shallow_sort(before, group)
    found = np.zeros((len(data), SPAN + 1), bool)
    class_after, class_before = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    for d in range(SPAN + 1):
        own = np.flatnonzero((offset >= d) & (offset - windows < d))
        if len(own) < 2:
            continue
        class_after[after_order] = np.cumsum(after_common < SPAN - d)
        class_before[before_order] = np.cumsum(before_common < d)
        cell = class_after[own] * (len(data) + 1) + class_before[own]
        at = np.argsort(cell, kind="stable")
        ranked = cell[at]
        new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        total = np.add.reduceat(n[own][at], new)
        found[own[at], d] = np.repeat(total > 1, np.diff(np.r_[new, len(at)]))
    return found


def sorted_groups(variants: DataFrame) -> DataFrame:
    """Byte ranges (key, low, high) of windows found several times, in groups of a bounded size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve() -> pa.RecordBatch:
            anchor, _, n, key, start, windows, offset, data = zip(*held, strict=True)
            group = np.cumsum(np.r_[0, np.diff(np.array(anchor)) != 0])
            windows, offset, start = np.array(windows), np.array(offset), np.array(start)
            found = repeated_windows(group, np.array(n), windows, offset, list(data))
            row, d = np.nonzero(found)
            single = np.array(n)[row] == 1
            row, d = row[single], d[single]
            at = start[row] + offset[row] - d
            order = np.lexsort((at, row))
            row, at = row[order], at[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(row)] - 1
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(key, np.int64)[row[first]]), pa.array(at[first].astype(np.int64)), pa.array((at[last] + WINDOW).astype(np.int64) if len(row) else np.zeros(0, np.int64))],
                ["key", "low", "high"],
            )

        for batch in batches:
            for record in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if len(held) >= BATCH_RUNS and record[0] != held[-1][0]:
                    yield solve()
                    held.clear()
                held.append(record)
        if held:
            yield solve()

    ordered = variants.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(work, "key long, low long, high long")


def halves(rows: DataFrame) -> DataFrame:
    """Runs of large groups cut to either half of their offsets, in groups by what all windows of the half hold.

    rows: anchor, lo and hi (the offsets the group is about), and the run's n, key, start, windows, offset, run.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for anchor, lo, hi, n, key, start, windows, offset, run in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                middle = (lo + hi) // 2
                for low, high in ((lo, middle), (middle + 1, hi)):
                    first, last = min(offset, high), max(offset - windows + 1, low)
                    if first < last:
                        continue
                    count, at = first - last + 1, offset - first
                    own = run[at : at + count - 1 + WINDOW]
                    held = own[first - low : first] + own[first + GRAM : first + GRAM + SPAN - high]
                    mark = xxhash.xxh3_128_digest(held + anchor.to_bytes(8, "big", signed=True) + low.to_bytes(1, "big"))
                    out.append((mark, xxhash.xxh3_128_digest(own), low, high, n, key, start + at, count, first, own))
            columns = list(zip(*out, strict=True)) if out else [()] * 10
            kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], HALF)

    schema = ", ".join(f"{n} {'binary' if n in ('mark', 'print', 'run') else 'long'}" for n in HALF)
    return rows.select("anchor", "lo", "hi", "n", "key", "start", "windows", "offset", "run").mapInArrow(cut, schema)


def large_groups(variants: DataFrame) -> list[DataFrame]:
    """The same ranges of groups of any size, halved until a task holds each."""
    rows = variants.select("*", F.lit(0).cast("long").alias("lo"), F.lit(SPAN).cast("long").alias("hi"))
    found, same = [], ["mark", "print", "windows", "offset"]
    while True:
        rows = stored(halves(rows), "halves")
        if rows.isEmpty():
            return found
        kinds = rows.groupBy(*same).agg(F.sum("n").alias("total"), F.min(F.struct("key", "start")).alias("one"))
        kinds = stored(kinds.select(*same, "total", "one.key", "one.start"), "kinds")
        # Runs that are equal where the half looks repeat in all its windows.
        several = kinds.filter("total > 1").select(*same)
        high = (F.col("start") + F.col("windows") + (WINDOW - 1)).alias("high")
        found.append(rows.filter("n = 1").join(several, same, "left_semi").select("key", F.col("start").alias("low"), high))
        sizes = kinds.groupBy("mark").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        left = rows.drop("n").join(kinds.withColumnRenamed("total", "n"), [*same, "key", "start"]).join(sizes, "mark")
        left = stored(left.withColumn("anchor", F.xxhash64("mark")), "variants")
        small = left.filter(F.col("kinds") <= HOT_RUNS)
        found.append(sorted_groups(small.select("anchor", F.lit(0).alias("span"), "n", "key", "start", "windows", "offset", "run")))
        rows = left.filter(F.col("kinds") > HOT_RUNS)


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """Byte ranges (key, low, high) to remove, overlapping or not; rows: (key, text)."""
    all_runs = stored(occurrences(rows), "runs")
    several = all_runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("least"), F.max("span").alias("most"))
    # Written first: joined to a table, not to its own grouping, a frequent anchor's rows can be split over tasks.
    several = stored(several.filter("n > 1").select("anchor", (F.col("least") != F.col("most")).alias("mixed")), "several")
    shared = stored(all_runs.join(several, "anchor"), "shared")

    kinds = shared.filter("mixed").groupBy("anchor", "span", "windows", "offset").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start")).alias("one")
    )
    kinds = stored(kinds.select("anchor", "span", "windows", "offset", "n", "one.key", "one.start"), "kinds")
    hot = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > HOT_RUNS).select("anchor")
    variants = fetched(kinds, rows).join(hot.withColumn("hot", F.lit(True)), "anchor", "left")
    variants = stored(variants, "variants")

    whole = (F.col("start") + F.col("windows") + (WINDOW - 1)).alias("high")
    copies = shared.filter("NOT mixed").select("key", F.col("start").alias("low"), whole)
    copied = kinds.filter("n > 1").select("anchor", "span")
    copies = copies.unionByName(
        shared.filter("mixed").join(copied, ["anchor", "span"], "left_semi").select("key", F.col("start").alias("low"), whole)
    )
    parts = sorted_groups(variants.filter("hot IS NULL").drop("hot"))
    found = copies.unionByName(parts)
    for more in large_groups(variants.filter("hot").drop("hot")):
        found = found.unionByName(more)
    return found


def with_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text and the sorted byte ranges to remove (null: none) of every row."""
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(key.alias("key"), "text")
    ranges = repeated_ranges(rows).distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges"))
    ranges = stored(ranges, "ranges")
    return docs.select("doc_id", "text", key.alias("key")).join(ranges, "key", "left").select("doc_id", "text", "ranges")


def removed(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs."""
    spans: list[tuple[int, int]] = []
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), spans


def _per_document(docs: DataFrame, make, schema: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(2)
            out = []
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = lists[i]
                low, high = (own.values.field(n).to_numpy() if own.is_valid else np.zeros(0, np.int64) for n in ("low", "high"))
                data = _bytes(text)
                out.append((doc_id, *make(data, *removed(data, low, high))))
            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    names = kinds.names
    return with_ranges(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(work, schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, the remaining bytes, and the removed spans of every document."""
    schema = "doc_id long, kept binary, spans array<struct<low: long, high: long>>"
    return _per_document(docs, lambda data, kept, spans: (kept, [{"low": a, "high": b} for a, b in spans]), schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""

    def digest(data: bytes, kept: bytes, spans: list) -> tuple:
        return len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()

    return _per_document(docs, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
