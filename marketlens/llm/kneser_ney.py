"""Interpolated modified Kneser-Ney model of word pairs, and the scores of texts.

Tasks count words and pairs of a few million tokens at a time and send each
bucket what it owns as arrays, so that a frequent word or pair crosses the
shuffle once per task. Pairs are dealt by their first word; those of the few
words that hold more than 1 / `HOT_SHARE` of all tokens are dealt by both words.
Buckets write sorted arrays of hashes with counts to the shared folder, and the
scoring tasks memory-map these files and search them for the distinct words and
pairs of their own texts.

The order is two: words follow each other at random beyond that in most of a
corpus, and the counts of longer n-grams would be several times its size.

p(w | v) = (c(vw) - D) / c(v) + g(v) * q(w), with q from the number of distinct
words before w, discounted alike and mixed with 1 / (V + 1). A text's first
word follows a mark of its own; every text is closed by one end token.

Defined cases: a null or empty text is its end token; a null doc_id belongs to
the training documents; repeated rows are counted and scored each; an empty
table, or one without training documents, gives no or uniform probabilities;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import scratch, slices, stored
from marketlens.llm.mapped import Shelf, write_array
from marketlens.llm.shingles import FACTOR, lower_words, mixed

TASK_TOKENS = 2_000_000
BUCKET_TOKENS = 1_500_000
MOST_BUCKETS = 8192
HOT_SHARE = 1000
BASE = 0.1
BEGIN, END = b" begin", b" end"  # no word holds a blank
WORD = np.dtype([("count", "<i8"), ("before", "<i8"), ("total", "<i8"), ("n1", "<i8"), ("n2", "<i8"), ("n3", "<i8")])
PAIR = np.dtype([("count", "<u4")])
BLOBS = "bucket int, kind string, first binary, second binary, numbers binary"


def _write(folder: str, name: str, hashes: np.ndarray, entries: np.ndarray) -> str:
    """Sorted hashes and their entries as two arrays; their places."""
    return f"{write_array(folder, name, hashes)}|{write_array(folder, name, entries)}"


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def pair_bucket(first: np.ndarray, second: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    dealt = np.where(np.isin(first, hot), mixed(second + first * FACTOR), first)
    return bucket_of(dealt, buckets)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * FACTOR + second)


class Numbers(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Chunk:
    """Token numbers of some texts, and the hashes of their words."""

    def __init__(self):
        self.numbers = Numbers({BEGIN: 0, END: 1})
        self.parts: list[np.ndarray] = []
        self.tokens = 0

    def add(self, text: str | None) -> None:
        words = lower_words(text)
        own = np.empty(len(words) + 2, np.int64)
        own[0], own[-1] = 0, 1
        own[1:-1] = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.parts.append(own)
        self.tokens += len(words) + 1

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes by number; per token its number, and the number before."""
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.numbers), np.uint64, len(self.numbers))
        second = np.concatenate([p[1:] for p in self.parts])
        first = np.concatenate([p[:-1] for p in self.parts])
        return hashes, first, second


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for text in batch.column(column):
            chunk.add(text.as_py())
            if chunk.tokens >= TASK_TOKENS:
                yield chunk
                chunk = Chunk()
    if chunk.parts:
        yield chunk


def _blobs(kind: str, bucket: np.ndarray, first: np.ndarray, second: np.ndarray | None, numbers: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with the arrays it owns, in the order of `first`."""
    at = np.lexsort((first, bucket))
    bucket = bucket[at]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(at) else np.zeros(0, np.int64)
    ranges = list(zip(edge, np.r_[edge[1:], len(at)], strict=True)) if len(at) else []
    arrays = [first[at], None if second is None else second[at], numbers[at]]
    columns = [pa.array([None if a is None else a[lo:hi].tobytes() for lo, hi in ranges], pa.binary()) for a in arrays]
    names = ["bucket", "kind", "first", "second", "numbers"]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array([kind] * len(ranges), pa.string()), *columns], names)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each bucket; the partition is sorted by bucket."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held[0][0], held
                held = []
            held.append(row)
    if held:
        yield held[0][0], held


def _by_bucket(blobs: DataFrame, buckets: int) -> DataFrame:
    return blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def word_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """Blobs (hashes, counts) of the words of training texts, summed by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 0):
            hashes, _, second = chunk.finish()
            counts = np.bincount(second, minlength=len(hashes))
            seen = np.flatnonzero(counts)
            yield _blobs("count", bucket_of(hashes[seen], buckets), hashes[seen], None, counts[seen].astype(np.int64))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches):
            hashes = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
            counts = np.concatenate([np.frombuffer(r[4], np.int64) for r in rows])
            known, at = np.unique(hashes, return_inverse=True)
            total = np.bincount(at, counts, len(known)).astype(np.int64)
            yield _blobs("count", np.full(len(known), bucket), known, None, total)

    return _by_bucket(texts.select("text").mapInArrow(count, BLOBS), buckets).mapInArrow(merge, BLOBS)


def frequent(counts: DataFrame, least: int) -> np.ndarray:
    """Hashes of words counted more than `least` times."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, numbers in zip(batch.column("first").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                own = np.frombuffer(first, np.uint64)[np.frombuffer(numbers, np.int64) > least]
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["hash"])

    found = [r[0] for r in counts.mapInArrow(find, "hash long").collect()]  # fewer than HOT_SHARE
    return np.array(found, np.int64).view(np.uint64)


def pair_counts(texts: DataFrame, hot: np.ndarray, buckets: int, folder: str) -> DataFrame:
    """Write the pairs' arrays; blobs of what they say about words, and rows 'file' and 'times'."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 0):
            hashes, first, second = chunk.finish()
            pairs, counts = np.unique(first * len(hashes) + second, return_counts=True)
            one, two = hashes[pairs // len(hashes)], hashes[pairs % len(hashes)]
            yield _blobs("pair", pair_bucket(one, two, hot, buckets), one, two, counts.astype(np.uint32))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches):
            one, two = (np.concatenate([np.frombuffer(r[i], np.uint64) for r in rows]) for i in (2, 3))
            counts = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows]).astype(np.int64)
            at = np.lexsort((two, one))
            one, two, counts = one[at], two[at], counts[at]
            new = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            one, two, counts = one[new], two[new], np.add.reduceat(counts, new)
            hashes = pair_hash(one, two)
            at = np.argsort(hashes)
            place = _write(folder, f"pairs-{bucket:05d}", hashes[at], counts[at].astype(PAIR["count"]).view(PAIR))
            start = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
            stats = np.column_stack([counts, counts == 1, counts == 2, counts > 2])
            stats = np.add.reduceat(stats, start, axis=0).astype(np.int64)
            yield _blobs("context", bucket_of(one[start], buckets), one[start], None, stats)
            known, before = np.unique(two, return_counts=True)
            yield _blobs("before", bucket_of(known, buckets), known, None, before.astype(np.int64))
            times = np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array(["file"]), pa.array([place.encode()]), pa.array([None], pa.binary()), pa.array([times.tobytes()])],
                ["bucket", "kind", "first", "second", "numbers"],
            )

    return _by_bucket(texts.select("text").mapInArrow(count, BLOBS), buckets).mapInArrow(merge, BLOBS)


def word_arrays(blobs: DataFrame, buckets: int, folder: str) -> DataFrame:
    """Write the words' arrays; rows 'file' with sums over the bucket's words."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = {"count": ["count"], "before": ["before"], "context": ["total", "n1", "n2", "n3"]}
        for bucket, rows in _grouped(batches):
            parts = [(r[1], np.frombuffer(r[2], np.uint64), np.frombuffer(r[4], np.int64)) for r in rows]
            known = np.unique(np.concatenate([h for _, h, _ in parts]))
            entries = np.zeros(len(known), WORD)
            for kind, hashes, numbers in parts:
                at = np.searchsorted(known, hashes)  # hashes of a blob are distinct
                for i, field in enumerate(fields[kind]):
                    entries[field][at] += numbers.reshape(len(hashes), -1)[:, i]
            place = _write(folder, f"words-{bucket:05d}", known, entries)
            before = entries["before"]
            sums = [entries["count"].sum(), (entries["count"] > 0).sum(), before.sum(), *((before == k).sum() for k in (1, 2, 3, 4)), (before > 2).sum()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array(["file"]), pa.array([place.encode()]), pa.array([None], pa.binary()), pa.array([np.array(sums, np.int64).tobytes()])],
                ["bucket", "kind", "first", "second", "numbers"],
            )

    return _by_bucket(blobs, buckets).mapInArrow(merge, BLOBS)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0 to 3 and more, from how many pairs occur one to four times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [0.0] + [k - (k + 1) * y * after / own if own else 0.0 for k, own, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.clip(raw, 0.0, [0.0, 1.0, 2.0, 3.0])


class Model:
    """Places of the arrays and the few numbers that hold for the whole model."""

    def __init__(self, buckets: int, hot: np.ndarray, pairs: dict[int, str], words: dict[int, str], times: np.ndarray, sums: np.ndarray):
        self.buckets, self.hot, self.pairs, self.words = buckets, hot, pairs, words
        self.tokens, self.known, self.before_all = (int(x) for x in sums[:3])
        self.pair_discount, self.word_discount = discounts(*times.tolist()), discounts(*sums[3:7].tolist())
        left = float(np.dot(self.word_discount[1:], [sums[3], sums[4], sums[7]]))
        self.uniform = (left / self.before_all if self.before_all else 1.0) / (self.known + 1)

    def find(self, shelf: Shelf, places: dict[int, str], bucket: np.ndarray, hashes: np.ndarray, kind: np.dtype) -> np.ndarray:
        """Entries of hashes, zeros where the model has none."""
        out = np.zeros(len(hashes), kind)
        at = np.lexsort((hashes, bucket))
        dealt = bucket[at]
        edge = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]])
        for lo, hi in zip(edge, np.r_[edge[1:], len(at)], strict=True):
            if (place := places.get(int(dealt[lo]))) is None:
                continue
            stored_hashes, entries = (shelf.open(p) for p in place.split("|"))
            own = at[lo:hi]
            found = np.minimum(np.searchsorted(stored_hashes, hashes[own]), len(entries) - 1)
            hit = stored_hashes[found] == hashes[own]
            out[own[hit]] = entries[found[hit]]
        return out

    def score(self, shelf: Shelf, chunk: Chunk) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score and score."""
        hashes, first, second = chunk.finish()
        word = self.find(shelf, self.words, bucket_of(hashes, self.buckets), hashes, WORD)
        base = np.log10((word["count"] + BASE) / (self.tokens + BASE * (self.known + 1)))
        before = word["before"]
        lower = (before - self.word_discount[np.minimum(before, 3)]) / max(1, self.before_all) + self.uniform
        pairs, at = np.unique(first * len(hashes) + second, return_inverse=True)
        one, two = pairs // len(hashes), pairs % len(hashes)
        bucket = pair_bucket(hashes[one], hashes[two], self.hot, self.buckets)
        count = self.find(shelf, self.pairs, bucket, pair_hash(hashes[one], hashes[two]), PAIR)["count"].astype(np.int64)
        total = word["total"][one]
        d = self.pair_discount
        weight = d[1] * word["n1"][one] + d[2] * word["n2"][one] + d[3] * word["n3"][one]
        seen = total > 0
        total = np.maximum(total, 1)
        chance = np.where(seen, (count - d[np.minimum(count, 3)]) / total + weight / total * lower[two], lower[two])
        length = np.array([len(p) - 1 for p in chunk.parts])
        start = np.cumsum(length) - length
        per_text = [np.add.reduceat(x, start) for x in ((word["count"] > 0)[second].astype(np.int64), base[second], np.log10(chance)[at])]
        return length, *per_text


def train(texts: DataFrame) -> Model:
    """Count a model over the column `text`."""
    spark = texts.sparkSession
    folder = scratch(spark, "model")
    size = int(texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0])
    buckets = int(min(max(1, size // (5 * BUCKET_TOKENS)), MOST_BUCKETS))
    counts = stored(word_counts(texts, buckets), "words")
    total = counts.mapInArrow(_total, "total long").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    hot = frequent(counts, int(total) // HOT_SHARE)
    said = stored(pair_counts(texts, hot, buckets, folder), "pairs")
    written = said.filter("kind = 'file'").select("bucket", "first", "numbers").collect()  # one row per bucket
    pairs = {r[0]: bytes(r[1]).decode() for r in written}
    times = sum((np.frombuffer(bytes(r[2]), np.int64) for r in written), np.zeros(4, np.int64))
    files = stored(word_arrays(counts.unionByName(said.filter("kind <> 'file'")), buckets, folder), "arrays")
    written = files.select("bucket", "first", "numbers").collect()  # one row per bucket
    words = {r[0]: bytes(r[1]).decode() for r in written}
    sums = sum((np.frombuffer(bytes(r[2]), np.int64) for r in written), np.zeros(8, np.int64))
    return Model(buckets, hot, pairs, words, times, sums)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [int(np.frombuffer(x, np.int64).sum()) for x in batch.column("numbers").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], ["total"])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; docs: (doc_id, held_out, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf()
        try:
            chunk, ids, held = Chunk(), [], []

            def result() -> pa.RecordBatch:
                length, known, base, own = model.score(shelf, chunk)
                columns = [
                    pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(length.astype(np.int64)),
                    pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), model.tokens, np.int64)), pa.array(base), pa.array(own),
                ]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                return pa.RecordBatch.from_arrays(columns, names)

            for batch in slices(batches):
                ids += batch.column(0).to_pylist()
                held += batch.column(1).to_pylist()
                for text in batch.column(2).to_pylist():
                    chunk.add(text)
                if chunk.tokens >= TASK_TOKENS:
                    yield result()
                    chunk, ids, held = Chunk(), [], []
            if ids:
                yield result()
        finally:
            shelf.close()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(score, schema)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Train on the documents whose CRC-32 of the id does not end in 0, score all."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    marked = docs.select("doc_id", held.alias("held_out"), "text")
    return scores(marked, train(marked.filter("NOT held_out").select("text")))
