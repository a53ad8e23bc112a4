"""Near duplicates by an LSH forest over MinHash signatures.

1. Every document gets its set of 5-word shingles, a fingerprint of the set and
   a MinHash signature. Documents of equal sets form a class; the class is the
   node of all that follows.
2. Each tree orders the signatures by their values from another place on. Only
   nodes that share the first `MIN_DEPTH` values with some other node go on;
   those that share them are a group of the tree.
3. First pass, over the orders of a few trees: a run of neighbours with a common
   prefix is a region. Where a region holds more than `REGION` nodes, longer
   prefixes cut it, as deep as it needs there; neighbours across such a cut stay
   candidates. A spanning forest of each region, by agreement of the signatures,
   is confirmed on the full sets. That connects groups of copies by about one
   link a node; it need not find all.
4. Second pass, over the groups of all trees that still hold unconnected nodes,
   whole and without cuts: nodes meet by odd sketches of their sets, bitmaps of
   the parity of shingles. Two bitmaps differ in at most as many bits as the sets
   differ in shingles, so a pair that differs in more cannot reach the threshold,
   and few others pass. Groups too large for a task are dealt to cells: one for
   each pair of blocks, and one for each block by itself. Again a spanning forest
   between what is not connected is confirmed.
5. Where a link of such a forest was refuted, what it stood for is not settled:
   all pairs of those groups that pass and are still unconnected are confirmed.

So a link can only be missed by the signatures: a pair at the threshold shares a
group in one of 16 trees with probability 1 - (1 - 0.75^2)^16, more than
0.999998, however crowded its group is. Sets of more than some thousand shingles
fill their bitmaps; there the bound is that of six standard deviations.

Defined cases: null or empty texts and texts without words have no shingles and
are linked with nothing; a null doc_id is linked with nothing and has a null
component; rows of one doc_id are one node per set, named by it; repeated rows
get the same result; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import batches_of, by_position, slices, stored
from marketlens.llm.components import components
from marketlens.llm.shingles import shingle_set

HASHES = 128
TREES = 16
MIN_DEPTH = 2
ORDER_DEPTH = 12
REGION = 600
# Trees of the first pass, and rows of one order its tasks hold at once.
FIRST_TREES = (0, 5, 10, 15)
HELD = 4 * REGION
# Nodes of a block in the second pass; a task holds two blocks.
BLOCK = 4096
# Rows, of whole texts or sets, that pass to Python at once.
ROWS_AT_ONCE = 1024
# Pairs a task of the second pass gives out at once.
PAIRS_AT_ONCE = 20_000
# Bits of the odd sketch of a small set, and of the largest.
LEAST_BITS, MOST_BITS = 4096, 1 << 17
THRESHOLD_PERCENT = 75
SEED = 20250


def agreeing(hashes: int) -> int:
    """Agreeing values a candidate needs: four standard deviations below those of a pair at the threshold."""
    return int(hashes * (0.75 - 4 * (0.75 * 0.25 / hashes) ** 0.5))


def _factors(hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED + hashes))
    return rng.integers(1, 2**63, hashes, np.uint64) | np.uint64(1), rng.integers(0, 2**63, hashes, np.uint64)


def signature(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray], at_once: int = 1024) -> np.ndarray:
    """Smallest of each hash function, upper 32 bits."""
    a, b = factors
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), at_once):
        part = shingles[at : at + at_once]
        np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint (two longs) and signature of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for batch in slices(batches):
            sizes, high, low, signs = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text)
                print_ = xxhash.xxh3_128_digest(own.tobytes())
                sizes.append(len(own))
                high.append(int.from_bytes(print_[:8], "big", signed=True))
                low.append(int.from_bytes(print_[8:], "big", signed=True))
                signs.append(signature(own, factors).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signs, pa.binary())],
                ["doc_id", "n_shingles", "high", "low", "sign"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, high long, low long, sign binary")


def tree_keys(nodes: DataFrame) -> DataFrame:
    """(node, tree, key): the first values of each tree's order as one number."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.arange(TREES) * (HASHES // TREES)
        for batch in slices(batches, 4096):
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, HASHES)
            key = np.zeros((len(signs), TREES), np.uint64)
            for d in range(MIN_DEPTH):
                key = key * np.uint64(1 << 32) + signs[:, starts + d]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(signs))), pa.array(key.ravel().view(np.int64))],
                ["node", "tree", "key"],
            )

    return nodes.select("node", "sign").mapInArrow(keys, "node long, tree int, key long")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(node, tree, key) of the nodes that share a tree's first prefix with another."""
    keys = tree_keys(nodes)
    crowded = keys.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tree", "key")
    return keys.join(crowded, ["tree", "key"]).select("node", "tree", "key")


def forest(nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows (tree, place, node, short) of the nodes in the trees `keyed` names: sort key and short signature."""
    wanted = keyed.groupBy("node").agg(F.collect_list("tree").alias("trees"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for node, sign, trees in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = np.frombuffer(sign, "<u4")
                short = values.astype(np.uint8).tobytes()
                for tree in trees:
                    turned = np.roll(values, -tree * (HASHES // TREES))[:ORDER_DEPTH]
                    out.append((tree, turned.astype(">u4").tobytes(), node, short))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["tree", "place", "node", "short"])

    rows = nodes.select("node", "sign").join(wanted, "node").select("node", "sign", "trees")
    return rows.mapInArrow(place, "tree int, place binary, node long, short binary")


def _regions(places: list[bytes], lo: int, hi: int, depth: int) -> Iterator[tuple[int, int]]:
    """Cut sorted places into runs with a common prefix, deeper where a run is large."""
    at = lo
    while at < hi:
        prefix, end = places[at][: 4 * depth], at + 1
        while end < hi and places[end].startswith(prefix):
            end += 1
        if end - at <= REGION:
            yield at, end
        elif depth < ORDER_DEPTH:
            yield from _regions(places, at, end, depth + 1)
        else:
            yield from ((x, min(x + REGION, end)) for x in range(at, end, REGION))
        at = end


class Groups:
    """Which numbers are connected so far."""

    def __init__(self, numbers: int):
        self.root = list(range(numbers))

    def joined(self, x: int, y: int) -> bool:
        """Connect two numbers; whether they were apart."""
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[y] = x
        return x != y


def _spanning(short: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a region's pairs that agree enough, by agreement."""
    first, second, agree = [], [], []
    least = agreeing(short.shape[1])
    for i in range(len(short) - 1):
        same = (short[i + 1 :] == short[i]).sum(axis=1)
        hit = np.flatnonzero(same >= least)
        first.append(np.full(len(hit), i))
        second.append(i + 1 + hit)
        agree.append(same[hit])
    if not first:
        return
    a, b = np.concatenate(first), np.concatenate(second)
    groups = Groups(len(short))
    for n in np.argsort(-np.concatenate(agree), kind="stable"):
        if groups.joined(int(a[n]), int(b[n])):
            yield int(a[n]), int(b[n])


def candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes to confirm in the first pass. rows: (tree, place, node, short)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def run() -> pa.RecordBatch:
            places = [r[1] for r in held]
            node = np.array([r[2] for r in held], np.int64)
            short = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), -1)
            out: set[tuple[int, int]] = set()
            last = 0
            for lo, hi in _regions(places, 0, len(held), MIN_DEPTH):
                out.update((lo + x, lo + y) for x, y in _spanning(short[lo:hi]))
                if last and lo == last and (short[lo] == short[lo - 1]).sum() >= agreeing(short.shape[1]):
                    out.add((lo - 1, lo))
                last = hi
            pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
            ends = np.sort(node[pairs], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                other = held and (row[0] != held[0][0] or row[1][: 4 * MIN_DEPTH] != held[0][1][: 4 * MIN_DEPTH])
                if other or len(held) >= HELD:
                    if len(held) > 1:
                        yield run()
                    # What is cut at the bound goes on from its last row.
                    del held[: len(held) - (not other)]
                held.append(row)
        if len(held) > 1:
            yield run()

    ordered = rows.select("tree", "place", "node", "short").repartitionByRange("tree", "place", "node").sortWithinPartitions("tree", "place", "node")
    return ordered.mapInArrow(search, "a long, b long").distinct()


# ---------------------------------------------------------------------------
# Second pass
# ---------------------------------------------------------------------------


def sketch_bits(size: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (size - 1).bit_length()))


def odd_sketches(sets: DataFrame) -> DataFrame:
    """(node, size, odd): how many shingles a set has, and the parity of those that fall on each bit."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, odd = [], []
            for own in batch.column(1):
                shingles = np.frombuffer(own.as_buffer(), np.uint64)
                bits = sketch_bits(len(shingles))
                places = (shingles >> np.uint64(64 - (bits - 1).bit_length())).astype(np.int64)
                sizes.append(len(shingles))
                odd.append(np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary())], ["node", "size", "odd"]
            )

    return sets.select("node", "shingles").mapInArrow(sketch, "node long, size int, odd binary")


def most_bits_apart(sizes: np.ndarray, bits: int, percent: int = THRESHOLD_PERCENT) -> np.ndarray:
    """Bits in which the sketches of a similar pair differ at most, by the sum of both sizes.

    No more than the sets differ in shingles; where so many would collide on
    the bits, no more than expected of them and six standard deviations.
    """
    apart = np.floor(sizes * (100 - percent) / (100 + percent))
    two, four = (1 - 2 / bits) ** apart, (1 - 4 / bits) ** apart
    spread = bits / 4 * (1 - two**2) + bits * (bits - 1) / 4 * (four - two**2)
    return np.minimum(apart, bits / 2 * (1 - two) + 6 * np.sqrt(np.maximum(spread, 0)) + 1)


def _folded(odd: bytes, bits: int) -> np.ndarray:
    """A sketch with fewer bits: places that fall together cancel out."""
    words = np.frombuffer(odd, np.uint64)
    own = len(words) * 64
    if own == bits:
        return words
    # The upper bits of a shingle tell its place, so neighbouring places fall together.
    cells = np.unpackbits(words.view(np.uint8)).reshape(bits, own // bits)
    return np.packbits(np.bitwise_xor.reduce(cells, axis=1)).view(np.uint64)


class Cell:
    """Nodes that meet: their sketches, components and blocks."""

    def __init__(self, node: np.ndarray, component: np.ndarray, size: np.ndarray, block: np.ndarray, odd: list[bytes]):
        # The largest component comes last: nodes of the others are compared with it, its own are not walked through.
        _, number, count = np.unique(component, return_inverse=True, return_counts=True)
        order = np.lexsort((number, count[number]))
        self.node, self.size, self.block = node[order], size[order].astype(np.int64), block[order]
        self.group = number[order]
        self.odd = [odd[i] for i in order]
        self.crossing = len(np.unique(block)) > 1

    def passing(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For nodes one by one: those after it in other components that its sketch does not rule out, and how far inside the bound."""
        bits = np.array([8 * len(x) for x in self.odd])
        for own in np.unique(bits):
            # Sizes of a similar pair, and so their sketches, are at most one doubling apart.
            at = np.flatnonzero((bits == own) | (bits == 2 * own))
            words = np.stack([_folded(self.odd[i], int(own)) for i in at])
            group, size, block, narrow = self.group[at], self.size[at], self.block[at], bits[at] == own
            ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(at))
            end_of = ends[np.searchsorted(ends, np.arange(len(at)), "right")]
            for i in range(int(ends[-2]) if len(ends) > 1 else 0):
                later = np.arange(end_of[i], len(at))
                small, large = np.minimum(size[later], size[i]), np.maximum(size[later], size[i])
                meet = 100 * small >= THRESHOLD_PERCENT * large
                if not narrow[i]:
                    meet &= narrow[later]
                if self.crossing:
                    meet &= block[later] != block[i]
                later = later[meet]
                if not len(later):
                    continue
                apart = np.bitwise_count(words[later] ^ words[i]).sum(axis=1, dtype=np.int64)
                room = most_bits_apart(size[later] + size[i], int(own)) - apart
                hit = room >= 0
                if hit.any():
                    yield at[i], at[later[hit]], room[hit] / (size[later[hit]] + size[i])

    def pairs(self, spanning: bool) -> Iterator[tuple[int, int]]:
        """A spanning forest of the components by the passing pairs, or all of these."""
        groups = Groups(int(self.group.max()) + 1)
        for i, later, room in self.passing():
            if spanning:
                later = later[np.argsort(-room, kind="stable")]
            for j in later.tolist():
                if not spanning or groups.joined(int(self.group[i]), int(self.group[j])):
                    yield int(self.node[i]), int(self.node[j])


def open_groups(keyed: DataFrame, component: DataFrame) -> DataFrame:
    """Rows (tree, key, x, y, block, node, component) of groups with unconnected nodes, dealt to cells of one or two blocks."""
    rows = keyed.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    held = held.filter("low < high").select("tree", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = rows.join(held, ["tree", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block meets every block, itself included: its own nodes in the cell of it alone, the others' in cells of two.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("tree", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "component")


def met_pairs(rows: DataFrame, odd: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (a, b) of unconnected nodes of a cell that the sketches do not rule out, with their group (tree, key)."""
    columns = ["tree", "key", "x", "y", "block", "node", "component", "size", "odd"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            block, node, component, size = (table.column(n).to_numpy() for n in columns[4:8])
            found = Cell(node, component, size, block, table.column("odd").to_pylist()).pairs(spanning)
            while part := list(islice(found, PAIRS_AT_ONCE)):
                pairs = np.sort(np.array(part, np.int64), axis=1)
                tree, key = (np.full(len(pairs), table.column(n)[0].as_py()) for n in ("tree", "key"))
                arrays = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(tree, pa.int32()), pa.array(key, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "tree", "key"])

        cell = None
        for batch in batches:
            cells = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in columns[:4]], axis=1)
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if at == to:
                    continue
                if held and tuple(cells[at]) != cell:
                    yield from run()
                cell = tuple(cells[at])
                held.append(batch.slice(at, to - at))
        if held:
            yield from run()

    dealt = rows.join(odd, "node").select(*columns)
    dealt = dealt.repartition("tree", "key", "x", "y").sortWithinPartitions("tree", "key", "x", "y")
    return dealt.mapInArrow(search, "a long, b long, tree int, key long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Pairs whose full sets are similar enough: 100 * common >= percent * all. sets: (node, shingles)."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b"
    )
    return rows.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) for the documents that stand for the nodes; nodes: (node, high, low)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for node, text, high in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = shingle_set(text).tobytes()
                if int.from_bytes(xxhash.xxh3_128_digest(own)[:8], "big", signed=True) == high:
                    out.append((node, own))
            ids, own = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.binary())], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node").select("node", "text", "high")
    return rows.mapInArrow(collect, "node long, shingles binary").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    with batches_of(docs.sparkSession, ROWS_AT_ONCE):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    known = stored(sketches(docs), "sketches")
    nodes = (
        known.filter("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy("high", "low")
        .agg(F.min(F.struct("doc_id", "sign")).alias("least"))
        .select("high", "low", F.col("least.doc_id").alias("node"), F.col("least.sign").alias("sign"))
    )
    nodes = stored(nodes, "nodes")
    keyed = stored(shared_keys(nodes), "keys")
    members = nodes.join(keyed.select("node").distinct(), "node", "left_semi")
    sets = stored(shingle_sets(docs, members.select("node", "high")), "shingles")

    first = stored(candidates(forest(nodes, keyed.filter(F.col("tree").isin(*FIRST_TREES)))), "candidates")
    links = stored(confirmed(first, sets), "links")
    found = stored(components(links), "components")

    odd = stored(odd_sketches(sets), "odd-sketches")
    met = stored(met_pairs(open_groups(keyed, found), odd, True), "candidates")
    more = stored(confirmed(met.select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), sets), "links")
    links = links.unionByName(more)
    found = stored(components(links), "components")

    refuted = met.join(links, ["a", "b"], "left_anti")
    unsettled = keyed.join(refuted.select("tree", "key").distinct(), ["tree", "key"], "left_semi")
    tried = first.unionByName(met.select("a", "b")).distinct()
    rest = met_pairs(open_groups(unsettled, found), odd, False).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(stored(confirmed(rest, sets), "links"))
    found = stored(components(links), "components")

    named = nodes.select("high", "low", "node").join(found, "node", "left")
    named = named.select("high", "low", F.coalesce("component", "node").alias("component_id"))
    result = known.select("doc_id", "n_shingles", "high", "low").join(named, ["high", "low"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, one of each group of near duplicates; of rows that repeat a doc_id, one stays."""
    judged = stored(near_duplicates(docs), "near-duplicates")
    dropped = judged.filter("NOT kept").select("doc_id")
    rows, names = by_position(docs)
    own = f"c{names.index('doc_id')}"
    rows = rows.join(dropped.distinct().withColumnRenamed("doc_id", own), own, "left_anti").select(*rows.columns)
    repeated = judged.filter("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().filter("count > 1")
    repeated = repeated.select(F.col("doc_id").alias(own))
    if repeated.isEmpty():
        return rows.toDF(*names)
    once = rows.join(repeated, own, "left_anti").select(*rows.columns)
    return once.unionByName(rows.join(repeated, own, "left_semi").select(*rows.columns).dropDuplicates([own])).toDF(*names)
