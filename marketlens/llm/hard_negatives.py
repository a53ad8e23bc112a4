"""Hard negatives by a vertical scan of the vectors (BOND: branch and bound on decomposed data).

Vectors lie in blocks as columns, one per dimension, with the smallest and
largest value of each. An anchor reads the columns in descending order of its
own components. After some columns, a row's score is what it has so far plus
what the rest may still bring, between two bounds from the columns' smallest and
largest values. Rows whose bounds cannot meet what is asked leave the candidate
bitmap; those that are left after the last column have their exact score.

First the anchors ask for their positives: the k-th best lower bound among the
candidates rules out all whose upper bound is below. The positives' scores then
set the windows in which negatives are wanted, and in a second scan a candidate
stays while some window may need it: its bounds reach into the window, above the
k-th best lower bound of rows that surely lie in it.

Rows are dealt evenly to groups whose columns fit one task, whatever their
labels; every group meets all anchors, which stream through its task and are
held one at a time. The best of each group meet in ranked windows, which Spark
limits before it shuffles.

Defined cases: a row with a null label, a null vector, or a component that is
null or not finite (times `scale`) takes no part. A row without vec_id is no
anchor and sorts last among equal scores. Rows of one vec_id are rows of their
own. Vectors of different lengths have no score together; vectors without
components score zero. Scores past the range of a long are held at its ends.
An anchor without positives, and a positive without negatives, give no rows, and
an empty table gives none; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import stored

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 10
# Shares of the positive's score, in percent, between which a negative's score lies.
LOWEST, HIGHEST = 30, 90
# Components of a group's columns: some 32 MB in a task.
GROUP_COMPONENTS = 4_000_000
# Columns read between two looks at the bounds.
STEP = 8
EXACT = 2**53
LONG = np.iinfo(np.int64)

FOUND = "anchor long, place int, score long, id long"
Windows = list[tuple[int, int]]


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows that take part: row, id, label, vector."""
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * float(scale)) < float("inf"), F.lit(False)))
    return vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(sound).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )


def matrices(column: pa.ListArray, rows: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each vector length among the rows: their numbers, and their vectors times `scale`, rounded down."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(offsets)[rows]
    for length in np.unique(lengths):
        own = rows[lengths == length]
        yield own, np.floor(values[offsets[own][:, None] + np.arange(length)] * float(scale))


def kth_best(scores: np.ndarray, k: int):
    return np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, -k)[-k]


class Columns:
    """Vectors of one length by dimension."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        matrix, self.row, self.id, self.nameless, self.label = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.columns = np.ascontiguousarray(matrix.T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.large = np.maximum(np.abs(self.low), np.abs(self.high))
        self.whole = None

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, still: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the candidates that `still(lower, upper)` lets through to the end."""
        columns, low, high = self.columns, self.low, self.high
        if float(np.abs(anchor) @ self.large) >= EXACT:
            if self.whole is None:
                self.whole = np.array([[int(x) for x in c] for c in columns], object).reshape(columns.shape)
            anchor, columns = np.array([int(x) for x in anchor], object), self.whole
            low, high = columns.min(axis=1), columns.max(axis=1)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor[order] * low[order], anchor[order] * high[order]
        zero = np.zeros(1, anchor.dtype)
        rest_low = np.concatenate([np.cumsum(np.minimum(*ends)[::-1])[::-1], zero])
        rest_high = np.concatenate([np.cumsum(np.maximum(*ends)[::-1])[::-1], zero])
        alive = np.flatnonzero(candidates)
        score = np.zeros(len(alive), anchor.dtype)
        for at in range(0, len(order), STEP):
            dims = order[at : at + STEP]
            block = columns[dims][:, alive] if len(alive) < columns.shape[1] else columns[dims]
            score = score + anchor[dims] @ block
            seen = min(at + STEP, len(order))
            live = still(score + rest_low[seen], score + rest_high[seen])
            if not live.all():
                alive, score = alive[live], score[live]
            if not len(alive):
                break
        if score.dtype == object:
            score = np.clip(score, LONG.min, LONG.max)
        return alive, score.astype(np.int64)

    def best(self, alive: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.lexsort((self.id[alive], self.nameless[alive], ~score))[:k]
        return alive[first], score[first]

    def positives(self, anchor: np.ndarray, row: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of the anchor's label, without itself."""

        def still(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            return upper >= kth_best(lower, k) if len(lower) > k else np.ones(len(lower), bool)

        return self.best(*self.scan(anchor, (self.label == label) & (self.row != row), still), k)

    def negatives(self, anchor: np.ndarray, label: int, windows: Windows, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each window of scores, the k best rows of other labels in it."""

        def still(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            live = np.zeros(len(lower), bool)
            for least, most in windows:
                sure = lower[(lower >= least) & (upper <= most)]
                live |= (upper >= (kth_best(sure, k) if len(sure) >= k else least)) & (lower <= most)
            return live.astype(bool)

        alive, score = self.scan(anchor, self.label != label, still)
        for least, most in windows:
            inside = (score >= least) & (score <= most)
            yield self.best(alive[inside], score[inside], k)


def window_of(score: int) -> tuple[int, int]:
    """Least and greatest negative score to a positive score."""
    return max(-(-LOWEST * score // 100), LONG.min), min(HIGHEST * score // 100, LONG.max)


def scanned(rows: DataFrame, anchors: DataFrame, groups: int, k: int, scale: int) -> DataFrame:
    """Each group's best rows to every anchor, for its positives or, where it brings `scores`, the windows of these.

    `place` numbers the windows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, blocks, group = {}, {}, None
        for batch in batches:
            groups_of = batch.column("group").to_numpy()
            is_anchor = batch.column("is_anchor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(groups_of) != 0) | (np.diff(is_anchor) != 0)) + 1
            for run in np.split(np.arange(batch.num_rows), cuts):
                if not len(run):
                    continue
                if groups_of[run[0]] != group:
                    parts, blocks, group = {}, {}, groups_of[run[0]]
                if not is_anchor[run[0]]:
                    names = batch.column("id")
                    for own, matrix in matrices(batch.column("vector"), run, scale):
                        parts.setdefault(matrix.shape[1], []).append(
                            (
                                matrix,
                                batch.column("row").to_numpy()[own],
                                names.fill_null(0).to_numpy()[own],
                                names.is_null().to_numpy(zero_copy_only=False)[own],
                                batch.column("label").to_numpy()[own],
                            )
                        )
                    continue
                for length, held in parts.items():
                    blocks[length] = Columns(held)
                parts = {}
                yield from answers(batch, run, blocks)

    def answers(batch: pa.RecordBatch, run: np.ndarray, blocks: dict[int, Columns]) -> Iterator[pa.RecordBatch]:
        scores = batch.column("scores")
        for own, matrix in matrices(batch.column("vector"), run, scale):
            block = blocks.get(matrix.shape[1])
            if block is None:
                continue
            out = []
            for number, vector in zip(own.tolist(), matrix, strict=True):
                row, label = batch.column("row")[number].as_py(), batch.column("label")[number].as_py()
                if scores[number].is_valid:
                    windows = [window_of(s) for s in scores[number].as_py()]
                    out += [(row, p, *x) for p, x in enumerate(block.negatives(vector, label, windows, k))]
                else:
                    out.append((row, 0, *block.positives(vector, row, label, k)))
            sizes = [len(alive) for _, _, alive, _ in out]
            alive = np.concatenate([a for _, _, a, _ in out])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([r for r, *_ in out], np.int64), sizes)),
                    pa.array(np.repeat(np.array([p for _, p, *_ in out], np.int32), sizes)),
                    pa.array(np.concatenate([s for *_, s in out])),
                    pa.array(block.id[alive], mask=block.nameless[alive]),
                ],
                ["anchor", "place", "score", "id"],
            )

    dealt = rows.select(
        F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"),
        F.lit(False).alias("is_anchor"),
        *("row", "id", "label", "vector"),
        F.lit(None).cast("array<long>").alias("scores"),
    )
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("is_anchor"), "row", "id", "label", "vector", "scores"
    )
    # One task per group: its rows first, then the anchors one by one.
    return dealt.unionByName(asked).repartitionById(groups, F.col("group")).sortWithinPartitions("is_anchor").mapInArrow(scan, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, anchor_every: int = ANCHOR_EVERY
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, from rows as `prepared` gives them."""
    spark = rows.sparkSession
    rows = stored(rows, "vectors")
    components = rows.agg(F.sum(F.size("vector"))).first()[0] or 0
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-components // GROUP_COMPONENTS))
    anchors = rows.filter(F.col("id") % anchor_every == 0)
    near = ranked(scanned(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), groups, positives, scale), positives)
    near = stored(near.select("anchor", "rank", "score", "id"), "positives")
    # At most `positives` rows an anchor.
    sought = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).getField("score").alias("scores"))
    windowed = anchors.join(sought, anchors["row"] == sought["anchor"]).select("row", "id", "label", "vector", "scores")
    far = ranked(scanned(rows, windowed, groups, negatives, scale), negatives)
    far = far.select("anchor", (F.col("place") + 1).alias("positive_rank"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return far.join(near, ["anchor", "positive_rank"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
