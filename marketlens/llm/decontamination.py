"""Benchmark questions found in documents, also with other numbers, names and units.

Texts become sequences of template tokens: words without their punctuation, in
lower case, with numbers, units after numbers, and names (capitalised inside a
sentence) replaced by the type of a slot. Windows of `WINDOW` template tokens
are hash-joined with those of the benchmark. Along each alignment of a question
with a document the values in the slots have to map one to one: two numbers that
differ in the question may not become one, nor one become two. A question is
found where the windows that pass cover at least `COVERED` of its tokens.

The benchmark is indexed in blocks of at most `BLOCK_ITEMS` questions, each of a
size a task holds easily; every block is joined with all documents.

Defined cases: null and empty texts have no tokens and are never found; a
question of fewer tokens than a window is one window of its own; windows with
fewer than `LEAST_WORDS` words besides slots are found by their template where the
signs that stand alone between the tokens are the same as well (`What is 12 * 7?`
is found as `What is 15 * 9?`, not as `What is 15 + 9?`), and with fewer than
`DENSE_WORDS` words only with the same values in the slots, as is any question of
one window: every copy is found; questions that repeat are found each; a null doc_id is carried, a null item_id too;
repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import filtered, slices
from marketlens.llm.shingles import FACTOR, mixed

WINDOW = 8
LEAST_WORDS = 4
DENSE_WORDS = 2
COVERED = 0.5
BLOCK_ITEMS = 20_000
CACHED_WORDS = 500_000
# Units that count as such after a number, in lower case.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years cent cents dollar dollars usd eur euro euros yen percent degree degrees watt watts kw "
    "volt volts hz mph kmh kph".split()
)
MARKS = ".,;:!?'\"()[]{}|*#&%$<>-_/\\"
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
LITERAL, NUM, UNIT, NAME, NOTHING, LINE = range(6)
SLOT_HASHES = np.array([0, 0xA3C59AC3D1B54A33, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class Words(dict):
    """Numbers of raw words; per number the hash of the plain word, its kind, and whether it ends a sentence."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []
        self.kinds: list[int] = []
        self.ends: list[bool] = []
        self._arrays = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool))

    def __missing__(self, raw: bytes) -> int:
        text = raw.decode("utf-8", "surrogatepass")
        plain = text.strip(MARKS)
        if raw == b"\0":
            kind = LINE
        elif not plain:
            kind = NOTHING
        elif NUMBER.fullmatch(plain):
            kind = NUM
        elif plain.lower() in UNITS:
            kind = UNIT
        elif plain[0].isupper() and (len(plain) == 1 or plain[1:].islower()):
            kind = NAME
        else:
            kind = LITERAL
        self.hashes.append(xxhash.xxh3_64_intdigest((text if kind == NOTHING else plain.lower()).encode("utf-8", "surrogatepass")))
        self.kinds.append(kind)
        self.ends.append(kind == LINE or text.rstrip("\"')]").endswith((".", "!", "?", ":")))
        number = self[raw] = len(self)
        return number

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, kinds and ends of all words by their numbers; only what is new is converted."""
        known = len(self._arrays[0])
        if known < len(self):
            new = (self.hashes[known:], np.uint64), (self.kinds[known:], np.int64), (self.ends[known:], bool)
            self._arrays = tuple(np.concatenate([old, np.array(part, t)]) for old, (part, t) in zip(self._arrays, new, strict=True))
        return self._arrays


_words = Words()


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").replace(b"\0", b" ").replace(b"\n", b" \0 ").split()


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, kinds and value hashes of a text's tokens, and hashes of the signs that stand alone before them."""
    return templates([text])[1:]


def templates(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """The same of all tokens of several texts, after the number of the text each token is of."""
    global _words
    if len(_words) > CACHED_WORDS:
        _words = Words()
    raw = [_split(t) for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    at = np.fromiter(map(_words.__getitem__, chain.from_iterable(raw)), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    value, kind, ends = (known[at] for known in _words.arrays())
    starts = np.ones(len(at), bool)
    starts[1:] = ends[:-1] | (owner[1:] != owner[:-1])
    kind = np.where((kind == NAME) & starts, LITERAL, kind)
    full = kind < NOTHING
    signs = np.cumsum(np.where(kind == NOTHING, value, np.uint64(0)), dtype=np.uint64)[full]
    signs[1:] -= signs[:-1].copy()
    value, kind, owner = value[full], kind[full], owner[full]
    after_number = np.zeros(len(kind), bool)
    after_number[1:] = (kind[:-1] == NUM) & (owner[1:] == owner[:-1])
    kind = np.where((kind == UNIT) & ~after_number, LITERAL, kind)
    return owner, np.where(kind == LITERAL, value, SLOT_HASHES[kind]), kind, value, signs


def windows(hashes: np.ndarray, kinds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of a width, and how many words besides slots each has."""
    n = len(hashes) - width + 1
    if n < 1 or width < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled = rolled * FACTOR + hashes[k : k + n]
    words = np.r_[0, np.cumsum(kinds == LITERAL)]
    return mixed(rolled), words[width:] - words[:-width]


def exact_windows(values: np.ndarray, signs: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows at some places, of tokens (with or without the values in the slots) and the signs inside."""
    rolled = np.full(len(places), width, np.uint64)
    for k in range(width):
        rolled = rolled * FACTOR + values[places + k]
        if k:
            rolled += mixed(signs[places + k])
    return mixed(rolled)


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the known ones, which are sorted."""
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


class Index:
    """Windows of a block of questions: those with words enough by their template, others by their signs too, or by their values."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items: list[tuple] = []
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        # By width and by what tells the windows: template tokens (0) or values (1).
        exact: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        firsts: dict[tuple[int, int], set[int]] = defaultdict(set)
        for item_id, text in items:
            hashes, kinds, values, signs = template(text)
            width = min(WINDOW, len(hashes))
            if not width:
                continue
            rolled, words = windows(hashes, kinds, width)
            for i in np.flatnonzero(words >= LEAST_WORDS).tolist():
                found[width][int(rolled[i])].append((len(self.items), i))
            dense = np.flatnonzero((words < LEAST_WORDS) & (words >= DENSE_WORDS))
            others = np.flatnonzero((words < DENSE_WORDS) | (len(words) == 1))
            for by, tokens, places in ((0, hashes, dense), (1, values, others)):
                for i, own in zip(places.tolist(), exact_windows(tokens, signs, places, width).tolist(), strict=True):
                    exact[width, by][own].append((len(self.items), i))
                    firsts[width, by].add(int(tokens[i]))
            self.items.append((item_id, len(hashes), kinds, values))
        self.by_width = {w: (np.array(sorted(d), np.uint64), dict(d)) for w, d in found.items()}
        self.exact = {
            at: (np.array(sorted(firsts[at]), np.uint64), np.array(sorted(d), np.uint64), dict(d)) for at, d in exact.items()
        }

    def hits(self, owner: np.ndarray, hashes: np.ndarray, kinds: np.ndarray, values: np.ndarray, signs: np.ndarray) -> Iterator[tuple]:
        """(width, places, hashes, table) of the windows shared with questions, of the texts `owner` names."""
        for width, (known, where) in self.by_width.items():
            rolled, words = windows(hashes, kinds, width)
            inside = owner[: len(rolled)] == owner[width - 1 :][: len(rolled)]
            places = np.flatnonzero(_among(rolled, known) & (words >= LEAST_WORDS) & inside)
            yield width, places, rolled[places], where
        for (width, by), (first, known, where) in self.exact.items():
            tokens, count = (hashes, values)[by], max(0, len(hashes) - width + 1)
            places = np.flatnonzero(_among(tokens[:count], first) & (owner[:count] == owner[width - 1 :][:count]))
            rolled = exact_windows(tokens, signs, places, width)
            shared = _among(rolled, known)
            yield width, places[shared], rolled[shared], where

    def touched(self, texts: list[str | None]) -> np.ndarray:
        """Which texts share a window with a question: one pass over the windows of all texts together."""
        tokens = templates(texts)
        touched = np.zeros(len(texts), bool)
        for _, places, _, _ in self.hits(*tokens):
            touched[tokens[0][places]] = True
        return touched

    def found(self, texts: list[str | None]) -> list[list[tuple]]:
        """Of each text what `find` says; only texts that share a window are looked into."""
        return [self.find(t) if hit else [] for t, hit in zip(texts, self.touched(texts).tolist(), strict=True)]

    def find(self, text: str | None) -> list[tuple]:
        """(item_id, windows, covered share, changed slots) of the questions a text holds."""
        tokens = templates([text])
        values = tokens[3]
        lines: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for width, places, rolled, where in self.hits(*tokens):
            for place, own in zip(places.tolist(), rolled.tolist(), strict=True):
                for item, window in where[own]:
                    lines[item][place - window].add((window, width))
        out = []
        for item, aligned in sorted(lines.items()):
            item_id, size, own_kinds, own_values = self.items[item]
            covered, passed, changed = np.zeros(size, bool), 0, 0
            for shift, found in aligned.items():
                count, line, slots = _consistent(sorted(found), shift, own_kinds, own_values, values, size)
                passed, changed = passed + count, changed + slots
                covered |= line
            if covered.sum() >= COVERED * size:
                out.append((item_id, passed, float(covered.mean()), changed))
        return out


def _consistent(found: list[tuple[int, int]], shift: int, kinds: np.ndarray, asked: np.ndarray, values: np.ndarray, size: int) -> tuple[int, np.ndarray, int]:
    """Windows of one alignment whose slot values map one to one with those before; their tokens, and slots with other values."""
    there: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    covered, passed = np.zeros(size, bool), 0
    for window, width in found:
        fits, new = True, []
        for i in range(window, window + width):
            kind = int(kinds[i])
            if kind != LITERAL:
                a, b = (kind, int(asked[i])), (kind, int(values[i + shift]))
                new.append((a, b))
                if there.get(a, b[1]) != b[1] or back.get(b, a[1]) != a[1]:
                    fits = False
        if fits and all(p[0] != q[0] and p[1] != q[1] or p == q for p in new for q in new):
            for a, b in new:
                there[a], back[b] = b[1], a[1]
            covered[window : window + width] = True
            passed += 1
    return passed, covered, sum(a[1] != v for a, v in there.items())


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark, one block at a time."""
    count = max(1, -(-benchmark.count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for number in range(count):
        rows = benchmark.filter(block == number).select("item_id", "text").collect()  # about BLOCK_ITEMS rows
        yield Index(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, covered, changed_slots: one row per document and question found in it."""
    result = None
    for index in blocks(benchmark):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = index.found(batch.column(1).to_pylist())
                out = [(doc_id, *hit) for doc_id, hits in zip(batch.column(0).to_pylist(), found, strict=True) for hit in hits]
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                names = ["doc_id", "item_id", "n_windows", "covered", "changed_slots"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        schema = "doc_id long, item_id long, n_windows long, covered double, changed_slots long"
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema)
        result = found if result is None else result.unionByName(found)
    return result


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no question is found, with all their columns."""
    for index in blocks(benchmark):
        docs = filtered(docs, lambda batch, index=index: [not hits for hits in index.found(batch.column("text").to_pylist())])
    return docs
