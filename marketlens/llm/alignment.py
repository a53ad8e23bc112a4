"""Which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece
BPE. Where a token of both ends at the same byte, the text is cut; the tokens
between two cuts form a group, and every A-B pair of a group is a link.

The merge runs in lockstep: one state vector holds the A and B pointers of all
documents of a batch. A step advances, in every document at once, the pointer
whose token ends first, or both where they end together; there it emits the cut
with the tokens of its group, whose links follow from their ranges. Documents
that are done leave the vector. A long document enters as several sections, cut
where both tokenizers surely end a token, so that no step is spent on one alone.

Both tokenizers end a token before a blank that stands alone between two other
characters: the word pattern of A does not reach over it, and no piece of B
holds a blank after another character (checked; else texts stay whole). So texts
are encoded by the chunks between such blanks, each distinct chunk once a worker.

How many documents link a pair is counted in Spark from the distinct pairs of
each document. The counts go back to the documents by a broadcast while they are
few, and by a shuffled join otherwise.

Defined cases: a text that is null, empty, or not given back byte for byte by
both tokenizers has zeros and an empty digest; repeated or null doc_ids are
documents of their own, one row each; an empty table gives no rows; further
columns of the table are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import stored
from marketlens.llm.tokens import _byte_letters

VOCABULARY_A = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY_B = public_tokenizers.path("piece_bpe_32k.model")
# Distinct chunks a worker remembers, and the longest of them. They bound memory, never results.
CACHED_CHUNKS, CACHED_CHARS = 400_000, 64
SECTION_CHUNKS = 48
# Texts handled at once inside a task: rows and bytes of text (one text at least).
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20
LINK_BLOCK = 2_000_000
# Largest table of counted pairs that is broadcast; some 70 bytes a pair in each executor.
BROADCAST_PAIRS = 4_000_000

LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
WORD_START = "▁"

SCHEMA = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " pairs array<struct<pair: long, times: long>>"
)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + length), one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Growing:
    """Ragged rows of numbers, appended to."""

    def __init__(self):
        self.values, self.used = np.empty(1 << 16, np.int32), 0
        self.lengths, self.rows = np.empty(1 << 16, np.int32), 0

    @staticmethod
    def _put(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(store):
            store = np.concatenate([store, np.empty(max(len(store), len(more)), store.dtype)])
        store[used : used + len(more)] = more
        return store

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.values = self._put(self.values, self.used, values)
        self.lengths = self._put(self.lengths, self.rows, lengths)
        self.used += len(values)
        self.rows += len(lengths)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the rows, and the length of each."""
        starts = np.cumsum(self.lengths[: self.rows], dtype=np.int64) - self.lengths[: self.rows]
        lengths = self.lengths[rows].astype(np.int64)
        return self.values[ranges(starts[rows], lengths)], lengths


class Encoders:
    """Both tokenizers of a worker, and the ids of the chunks it has seen."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, at in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[at] = bytes(letters[x] for x in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(WORD_START, " ").encode() for i, p in enumerate(pieces)
        ]
        self.cuttable = not any(WORD_START in p.lstrip(WORD_START) for p in pieces)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids_a, self.ids_b, self.whole = Growing(), Growing(), np.empty(0, bool)

    def learn(self, chunks: list[str]) -> range:
        """Numbers of new chunks."""
        raw = [b" " + c.encode() for c in chunks]
        same = np.ones(len(raw), bool)
        for ids, known, words, sizes in (
            ([e.ids for e in self.a.encode_batch([" " + c for c in chunks], add_special_tokens=False)], self.ids_a, self.bytes_a, self.size_a),
            (self.b.encode(chunks, num_threads=1), self.ids_b, self.bytes_b, self.size_b),
        ):
            lengths = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
            known.extend(flat, lengths)
            spelled = b"".join(map(words.__getitem__, flat.tolist()))
            ends = np.concatenate([[0], np.cumsum(sizes[flat])])[np.cumsum(lengths)]
            if spelled != b"".join(raw) or not np.array_equal(ends, np.cumsum([len(x) for x in raw])):
                begins = np.concatenate([[0], ends[:-1]])
                same &= [spelled[x:y] == r for x, y, r in zip(begins, ends, raw, strict=True)]
        first = len(self.whole)
        self.whole = np.concatenate([self.whole, same])
        return range(first, len(self.whole))

    def chunks(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of all texts, and how many each text has."""
        if len(self.whole) > CACHED_CHUNKS:
            self.forget()
        parts = [(LONE_BLANK.split(t) if self.cuttable else [t]) if t else [] for t in texts]
        flat = [c for p in parts for c in p]
        new = list({c for c in flat if c not in self.numbers})
        once = dict(zip(new, self.learn(new), strict=True)) if new else {}
        found = [once[c] if c in once else self.numbers[c] for c in flat] if once else [self.numbers[c] for c in flat]
        self.numbers.update((c, n) for c, n in once.items() if len(c) <= CACHED_CHARS)
        return np.array(found, np.int64), np.array([len(p) for p in parts], np.int64)


_encoders: dict[tuple[str, str], Encoders] = {}


def encoders(path_a: str, path_b: str) -> Encoders:
    """The tokenizers of this worker process."""
    if (path_a, path_b) not in _encoders:
        _encoders[path_a, path_b] = Encoders(path_a, path_b)
    return _encoders[path_a, path_b]


def lockstep(
    end_a: np.ndarray, end_b: np.ndarray, at_a: np.ndarray, stop_a: np.ndarray, at_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Groups of all lanes: the token after each group's last one, of A and of B, in order.

    `end_a` and `end_b` hold the byte at which each token ends; lane k merges the
    tokens of A from at_a[k] to stop_a[k] with those of B from at_b[k], which end
    at the same byte.
    """
    a, b = at_a.copy(), at_b.copy()
    cuts_a, cuts_b = [], []
    while len(a):
        ends_a, ends_b = end_a[a], end_b[b]
        cut = ends_a == ends_b
        a += ends_a <= ends_b
        b += ends_b <= ends_a
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        live = a < stop_a
        if not live.all():
            a, b, stop_a = a[live], b[live], stop_a[live]
    if not cuts_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def starts_of(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]]) if len(ends) else ends


class Aligned:
    """Tokens and groups of a batch of texts; texts without tokens have none of either."""

    def __init__(self, enc: Encoders, texts: list[str | None]):
        chunks, per_text = enc.chunks(texts)
        owner = np.repeat(np.arange(len(texts)), per_text)
        broken = np.zeros(len(texts), bool)
        if len(chunks):
            broken[owner[~enc.whole[chunks]]] = True
        kept = ~broken[owner]
        place = (np.arange(len(chunks)) - np.repeat(np.cumsum(per_text) - per_text, per_text))[kept]
        chunks, owner = chunks[kept], owner[kept]
        self.ids_a, len_a = enc.ids_a.take(chunks)
        self.ids_b, len_b = enc.ids_b.take(chunks)
        after_a, after_b = np.cumsum(len_a), np.cumsum(len_b)
        first = place % SECTION_CHUNKS == 0
        at_a, at_b = (after_a - len_a)[first], (after_b - len_b)[first]
        stop_a = np.append(at_a[1:], len(self.ids_a))
        end_a, end_b = np.cumsum(enc.size_a[self.ids_a]), np.cumsum(enc.size_b[self.ids_b])
        self.cut_a, self.cut_b = lockstep(end_a, end_b, at_a, stop_a[: len(at_a)], at_b)
        self.n_a = np.bincount(owner, len_a, len(texts)).astype(np.int64)
        self.n_b = np.bincount(owner, len_b, len(texts)).astype(np.int64)
        self.many_a = np.diff(self.cut_a, prepend=0)
        self.many_b = np.diff(self.cut_b, prepend=0)
        self.text_of_group = np.searchsorted(np.cumsum(self.n_a), starts_of(self.cut_a), "right")
        self.n_groups = np.bincount(self.text_of_group, minlength=len(texts)).astype(np.int64)
        links = np.concatenate([[0], np.cumsum(self.many_a * self.many_b)])
        after = np.cumsum(self.n_groups)
        self.n_links = links[after] - links[after - self.n_groups]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All links in blocks: number of the text, token of A, token of B."""
        group = np.repeat(np.arange(len(self.cut_a)), self.many_a)
        width = self.many_b[group]
        before = np.cumsum(width) - width
        at = 0
        while at < len(group):
            to = max(at + 1, int(np.searchsorted(before, before[at] + LINK_BLOCK)))
            a = np.repeat(np.arange(at, to), width[at:to])
            b = ranges((self.cut_b - self.many_b)[group[at:to]], width[at:to])
            yield self.text_of_group[group[a]], self.ids_a[a], self.ids_b[b]
            at = to

    def pairs(self, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each text: number of the text, pair (id of A times the size of B, plus id of B), its links."""
        size = sizes[0] * sizes[1]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for text, a, b in self.links():
            found.append(np.unique(text * size + a.astype(np.int64) * sizes[1] + b, return_counts=True))
        keys, times = found[-1]
        if len(found) > 2:
            keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            times = np.bincount(back, np.concatenate([t for _, t in found])).astype(np.int64)
        return keys // size, keys % size, times

    def digests(self, digits: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """SHA-256 of the groups of each text as `a1,a2|b1;a3|b2`; empty where there are none."""
        table, width = digits
        groups = np.arange(len(self.cut_a))
        total = len(self.ids_a) + len(self.ids_b)
        ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[np.arange(len(self.ids_a)) + (self.cut_b - self.many_b)[np.repeat(groups, self.many_a)]] = self.ids_a
        ids[np.arange(len(self.ids_b)) + self.cut_a[np.repeat(groups, self.many_b)]] = self.ids_b
        mark[self.cut_a + self.cut_b - self.many_b - 1] = ord("|")
        mark[self.cut_a + self.cut_b - 1] = ord(";")
        wide = width[ids]
        cells = table[ids]
        cells[np.arange(total), wide] = mark
        line = cells[np.arange(table.shape[1]) <= wide[:, None]]
        ends = np.concatenate([[0], np.cumsum(wide + 1)])
        tokens = np.cumsum(self.n_a + self.n_b)
        return [
            hashlib.sha256(line[ends[to - n] : ends[to] - 1].tobytes()).hexdigest() if n else ""
            for to, n in zip(tokens.tolist(), (self.n_a + self.n_b).tolist(), strict=True)
        ]


def decimal_digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every number below `size` as a row of ASCII digits with room for one mark, and how many digits it has."""
    words = [str(i).encode() for i in range(size)]
    room = len(words[-1]) + 1
    return np.frombuffer(b"".join(w.ljust(room) for w in words), np.uint8).reshape(size, room), np.array(list(map(len, words)))


def text_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded rows and bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        at = 0
        while at < batch.num_rows:
            to = min(at + BATCH_ROWS, max(at + 1, int(np.searchsorted(before, before[at] + BATCH_BYTES))))
            yield batch.slice(at, to - at)
            at = to


def aligned(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """One row per document: counts, digest of its groups, and its distinct linked pairs with their links.

    `row` numbers the rows; `pair` is the id of A times the size of B's vocabulary, plus the id of B.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(path_a, path_b)
        sizes = len(enc.bytes_a), len(enc.bytes_b)
        digits = decimal_digits(max(sizes))
        for batch in text_batches(batches, "text"):
            got = Aligned(enc, batch.column("text").to_pylist())
            text, pair, times = got.pairs(sizes)
            offsets = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], ["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    *(pa.array(x) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)),
                    pa.array(got.digests(digits), pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), structs),
                ],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(align, SCHEMA)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """Of every linked pair: id_a, id_b, how many documents hold it, and whether no other pair of id_a has more."""
    counts = stored(rows.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    counts = counts.withColumn("id_a", F.expr(f"pair div {size_b}")).withColumn("id_b", F.col("pair") % size_b)
    # One row per id of A: no more than its vocabulary has.
    most = counts.groupBy("id_a").agg(F.max("docs").alias("most"))
    return counts.join(F.broadcast(most), "id_a").select("pair", "id_a", "id_b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def vocabulary_size_b(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


def link_scores(
    docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """Counts and digest of every document, its links whose pair is the best of its A id, and the sum of its links' counts."""
    rows = stored(aligned(docs, path_a, path_b), "aligned")
    counts = pair_counts(rows, vocabulary_size_b(path_b)).select("pair", "docs", "best")
    few = counts.count() <= broadcast_pairs
    links = rows.select("row", F.explode("pairs").alias("link")).select("row", "link.pair", "link.times")
    sums = (
        links.join(F.broadcast(counts) if few else counts, "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    )
    return rows.drop("pairs").join(sums, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
