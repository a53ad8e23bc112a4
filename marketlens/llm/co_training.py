"""Quality of documents by co-training two views, their text and their page metadata.

Each view has its own logistic classifier over binary features: hashed words and
binned measures of the whole text; language, source and binned length. Both
learn from labelled documents, then teach each other for some rounds: whatever
one view is sure of in a pool without labels counts as labelled for the other.
A part of the labelled documents is kept apart to calibrate both views and to
weigh them against each other; the result scores every document.

Good documents are those of quality 1 that are not toxic; the others are to go.

Fitting uses at most about `LABELLED` labelled and `POOL` other documents,
chosen by a hash of the id; scoring covers all.

Defined cases: a null or empty text has no words and is scored by its other
features; nulls in the metadata are values of their own; a null doc_id is never
used to fit but scored; repeated rows are scored each; without good and bad
labels every score is the share of good labels, 1 without any; labels without a
document, and null labels, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import filtered, slices
from marketlens.llm.shingles import CACHED_WORDS, lower_words

LABELLED = 12_000
POOL = 3_000
ROUNDS = 3
SURE = 0.97
PSEUDO_WEIGHT = 0.5
APART = 0.25
KEEP_FROM = 0.5
WORD_BITS = 16
FEWEST_DOCUMENTS = 5
# Standard errors by which the share of good documents with a feature differs from the share of all.
TELLING = 3.0
STEPS = 250
PENALTY = 3e-5
EDGES = (1e-9, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.999)
MEASURES = 9
TEXT_SIZE = (1 << WORD_BITS) + MEASURES * 32
META_SIZE = 64 + 512 + 64
MARKS = b".,;:!?'\"()|"


class WordPlaces(dict):
    def __missing__(self, word: bytes) -> int:
        place = self[word] = xxhash.xxh32_intdigest(word.strip(MARKS)) & ((1 << WORD_BITS) - 1)
        return place


_places = WordPlaces()


def text_features(text: str | None) -> np.ndarray:
    """Numbers of the features a text has."""
    if len(_places) > CACHED_WORDS:
        _places.clear()
    words = lower_words(text)
    own = set(words)
    data = np.bincount(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size, lines = max(1, int(data.sum())), [x for x in (text or "").split("\n") if x.strip()]
    letters = max(1, int(data[65:91].sum() + data[97:123].sum()))
    shares = [
        data[65:91].sum() / letters,
        sum(int(data[ord(c)]) for c in "#*$%&|<>") / size,
        sum(int(data[ord(c)]) for c in "!?") / size,
        data[48:58].sum() / size,
        1 - len(own) / max(1, len(words)),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, sum(map(len, words)) / max(1, len(words)) / 20),
        int(data[ord("|")]) / max(1, len(words)),
    ]
    bins = [*np.searchsorted(EDGES, shares, "right").tolist(), min(31, len(words).bit_length())]
    measures = [(1 << WORD_BITS) + 32 * i + b for i, b in enumerate(bins)]
    return np.unique(np.fromiter((*map(_places.__getitem__, own), *measures), np.int32))


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    def place(value: str | None, size: int) -> int:
        return size - 1 if value is None else xxhash.xxh32_intdigest(value) % (size - 1)

    length = 63 if n_chars is None else min(62, 3 * max(0, int(n_chars)).bit_length())
    return np.array([place(lang, 64), 64 + place(source, 512), 576 + length], np.int32)


class View:
    """Logistic regression over binary features given by number, with a Platt calibration."""

    def __init__(self, size: int, words: int = 0):
        """Features below `words` are words and count only if they tell something; the others always do."""
        self.words = words
        self.weights, self.bias, self.slope, self.shift = np.zeros(size), 0.0, 1.0, 0.0

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows]) + self.bias

    def fit(self, rows: list[np.ndarray], y: np.ndarray, share: np.ndarray) -> None:
        """Minimise the weighted log loss by Adam over all rows at once."""
        size = len(self.weights)
        place = np.concatenate(rows)
        length = np.array([len(r) for r in rows])
        owner, part = np.repeat(np.arange(len(rows)), length), y.mean()
        holders, good = np.bincount(place, minlength=size), np.bincount(place, y[owner], size)
        differs = (good - part * holders) ** 2 > TELLING**2 * part * (1 - part) * holders
        used = np.flatnonzero((holders >= FEWEST_DOCUMENTS) & differs | (holders > 1) & (np.arange(size) >= self.words))
        renumber = np.full(size, len(used))
        renumber[used] = np.arange(len(used))
        place = renumber[place]
        known = place < len(used)
        place, owner = place[known], owner[known]
        w, b = np.zeros(len(used)), float(np.log((share @ y + 1) / (share @ (1 - y) + 1)))
        m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        total = share.sum()
        for step in range(1, STEPS + 1):
            margin = np.bincount(owner, w[place], len(rows)) + b
            error = share * (1 / (1 + np.exp(-margin)) - y) / total
            gradient = np.append(np.bincount(place, error[owner], len(used)) + PENALTY * w, error.sum())
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        self.weights = np.zeros(size)
        self.weights[used], self.bias = w, b

    def calibrate(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        self.slope, self.shift = _logistic(self.raw(rows)[:, None], y)

    def logit(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.slope * self.raw(rows) + self.shift


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients and intercept of a small, slightly regularised logistic regression, by Newton's method."""
    x1 = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x1.shape[1])
    prior = np.append(np.full(x.shape[1], 1e-2), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(prior + 1e-9)
        beta = beta - np.linalg.solve(hessian, x1.T @ (p - y) + prior * beta)
        beta = np.clip(beta, -50, 50)
    return beta


class Classifier:
    """Both views and how to combine them."""

    def __init__(self, share: float):
        self.text, self.meta = View(TEXT_SIZE, 1 << WORD_BITS), View(META_SIZE)
        self.mix, self.share = np.zeros(3), share

    def probabilities(self, text: list[np.ndarray], meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of being good, by the text, by the metadata, and by both."""
        if not self.mix.any():
            same = np.full(len(text), self.share)
            return same, same, same
        t, m = self.text.logit(text), self.meta.logit(meta)
        both = self.mix[0] * t + self.mix[1] * m + self.mix[2]
        return tuple(1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in (t, m, both))


def co_train(text: list[np.ndarray], meta: list[np.ndarray], y: np.ndarray, labelled: np.ndarray, apart: np.ndarray, rounds: int = ROUNDS) -> Classifier:
    """Fit both views. y holds where labelled; `apart` marks labelled rows for calibration."""
    model = Classifier(float(y[labelled].mean()) if labelled.any() else 1.0)
    taught, held = np.flatnonzero(labelled & ~apart), np.flatnonzero(labelled & apart)
    if any(len(np.unique(y[at])) < 2 for at in (taught, held)):
        return model
    pool = np.flatnonzero(~labelled)
    views = [(model.text, text), (model.meta, meta)]
    lessons: list[dict[int, float]] = [{}, {}]
    for turn in range(rounds + 1):
        for (view, rows), extra in zip(views, lessons, strict=True):
            at = [*taught.tolist(), *extra]
            target = np.concatenate([y[taught], np.array(list(extra.values()))])
            share = np.concatenate([np.ones(len(taught)), np.full(len(extra), PSEUDO_WEIGHT)])
            view.fit([rows[i] for i in at], target, share)
            view.calibrate([rows[i] for i in held], y[held])
        if turn == rounds or not len(pool):
            break
        sure = np.log(SURE / (1 - SURE))
        for teacher, (view, rows) in enumerate(views):
            logit = view.logit([rows[i] for i in pool])
            lessons[1 - teacher].update((int(i), float(z > 0)) for i, z in zip(pool, logit, strict=True) if abs(z) > sure)
    logits = np.column_stack([view.logit([rows[i] for i in held]) for view, rows in views])
    model.mix = _logistic(logits, y[held])
    return model


def _share_of(rows: DataFrame, bound: int):
    """A condition on the hash of doc_id that about `bound` of the rows meet."""
    n = rows.count()
    return F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(min(1.0, bound / max(1, n)) * 1_000_000)


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on bounded samples of labelled and other documents."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))
    known = known.filter(_share_of(known, LABELLED))
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id IS NOT NULL")
    taught = own.join(F.broadcast(known), "doc_id")  # at most about LABELLED rows of 12 bytes
    pool = own.filter(_share_of(own, POOL)).join(F.broadcast(known), "doc_id", "left_anti").withColumn("good", F.lit(None).cast("int"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["good"] for r in rows], pa.int32()),
                    pa.array([text_features(r["text"]).tobytes() for r in rows]),
                    pa.array([meta_features(r["lang"], r["source"], r["n_chars"]).tobytes() for r in rows]),
                ],
                ["doc_id", "good", "words", "page"],
            )

    both = taught.unionByName(pool).mapInArrow(features, "doc_id long, good int, words binary, page binary")
    rows = sorted(both.collect(), key=lambda r: (r[0], r[2]))  # bounded by LABELLED and POOL
    text, meta = ([np.frombuffer(bytes(r[i]), np.int32) for r in rows] for i in (2, 3))
    y = np.array([r[1] or 0 for r in rows], float)
    labelled = np.array([r[1] is not None for r in rows], bool)
    apart = np.array([xxhash.xxh32_intdigest(str(r[0])) % 1000 < 1000 * APART for r in rows], bool)
    return co_train(text, meta, y, labelled, apart)


def scores(docs: DataFrame, model: Classifier, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, text_score, page_score, score and kept of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _judged(batch, model)
            columns = [pa.array(x) for x in found] + [pa.array(found[-1] >= keep_from)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "text_score", "page_score", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", "n_chars")
    return rows.mapInArrow(score, "doc_id long, text_score double, page_score double, score double, kept boolean")


def _judged(batch: pa.RecordBatch, model: Classifier) -> tuple[np.ndarray, ...]:
    text = [text_features(t) for t in batch.column("text").to_pylist()]
    page = [meta_features(*row) for row in zip(*(batch.column(n).to_pylist() for n in ("lang", "source", "n_chars")), strict=True)]
    return model.probabilities(text, page)


def accepted(docs: DataFrame, model: Classifier, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents whose score is high enough, with all their columns."""
    return filtered(docs, lambda batch: _judged(batch, model)[-1] >= keep_from)
