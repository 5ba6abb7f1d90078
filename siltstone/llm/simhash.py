"""SimHash near-duplicates: vantage-point trees over fingerprints, sharded with overlapping boundaries."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, map_arrow, settled, written

_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
QUARTERS = 4
#: Rows of a leaf of a local tree, which is compared with its queries at once.
LEAF = 64
#: Vantage points of the shared upper tree, in a quarter's 16 bits; how many are used, and so its depth, follows the number of nodes.
VANTAGE = (0x00FF, 0x0F0F, 0x3333, 0x5555, 0x1E2D, 0x6B4C, 0x35A9, 0x7C13, 0x2D66, 0x59E2)
SHALLOW = 4
#: Nodes of a shard that the depth aims at.
SHARD_NODES = 2_000


def _hashes(data: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of UTF-8 text, repeats included; A-Z are lower-cased."""
    words = _WORDS.findall(data.lower())  # bytes.lower changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, last)), dtype=np.uint64, count=len(last))


def _majority(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        ones += np.unpackbits(hashes[at : at + chunk].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of UTF-8 text: a bit is 1 if set in over half of the XXH64 hashes of the word shingles."""
    return _majority(_hashes(data, shingle, seed))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes as if of another seed, by the finalizer of SplitMix64; k = 0: the hashes themselves."""
    if not k:
        return hashes
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _fingerprints(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(made, dtype=np.uint64).view(np.int64))], ["id", "bits"])

    return work


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, bits): bits is the 64-bit fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    return map_arrow(rows, _fingerprints(shingle), "id long, bits long")


class Tree:
    """A vantage-point tree: each inner node's points are cut at their median Hamming distance from one of them."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, at: np.ndarray):
        # A path of halvings, so recursion is as deep as the logarithm of the points, unless all distances are equal.
        if len(at) <= LEAF:
            return at
        vantage = self.points[at[len(at) // 2]]
        far = np.bitwise_count(self.points[at] ^ vantage)
        cut = int(np.median(far))
        inside = far <= cut
        if inside.all():
            inside = far < cut
            cut -= 1
        if not inside.any() or inside.all():
            return at
        return vantage, cut, self._grow(at[inside]), self._grow(at[~inside])

    def pairs(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (of queries, of points) within radius; whole sets of queries go down the tree together.

        By the triangle inequality the inner branch is left out for queries farther from the vantage point than
        cut + radius, and the outer for those not farther than cut - radius.
        """
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, ask = stack.pop()
            if not len(ask):
                continue
            if isinstance(node, tuple):
                vantage, cut, inner, outer = node
                far = np.bitwise_count(queries[ask] ^ vantage).astype(np.int64)
                stack += [(inner, ask[far <= cut + radius]), (outer, ask[far > cut - radius])]
                continue
            for i in range(0, len(node), 1 << 12):
                for j in range(0, len(ask), 1 << 8):
                    some, other = node[i : i + (1 << 12)], ask[j : j + (1 << 8)]
                    q, p = np.nonzero(np.bitwise_count(queries[other][:, None] ^ self.points[some][None, :]) <= radius)
                    if len(q):
                        yield other[q], some[p]


#: Pairs that are looked at together while a forest grows.
PAIRS = 1 << 16


def _forest(tree: int, home: np.ndarray, wide: np.ndarray, radius: int, apart: int | None, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges, as positions, of a spanning forest of the links within one shard: fewer than its rows."""
    own = np.flatnonzero(home)
    bits = np.ascontiguousarray(wide[:, tree // QUARTERS])
    label = np.arange(len(bits))
    for found, p in Tree(bits[own]).pairs(bits, radius):
        for at in range(0, len(found), PAIRS):
            x, y = found[at : at + PAIRS], own[p[at : at + PAIRS]]
            while True:
                open_yet = label[x] != label[y]
                x, y = x[open_yet], y[open_yet]
                if apart is not None and len(x):
                    near = np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int64) <= apart
                    x, y = x[near], y[near]
                if not len(x):
                    break
                if not forest:
                    yield x, y
                    break
                # Each tree that meets one of a smaller label joins one such tree.
                high, low = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
                joins, first = np.unique(high, return_index=True)
                yield x[first], y[first]
                to = np.arange(len(bits))
                to[joins] = low[first]
                while (to[to] != to).any():
                    to = to[to]
                label = to[label]


def _forests(radius: int, words: int, apart: int | None, forest: bool):
    """Forests of the shards of rows (tree, shard, home, id, words) sorted by tree and shard."""

    def edges(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) < 2 or not rows[:, 2].any():
            return []
        found = _forest(int(rows[0, 0]), rows[:, 2] != 0, rows[:, 4:].view(np.uint64), radius, apart, forest)
        return [rows[np.stack(pair, axis=1), 3] for pair in found]

    def batch_of(out: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(out)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            ends = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            pieces = np.split(rows, ends)
            out = []
            if held and (held[-1][-1, :2] != rows[0, :2]).any():
                out += edges(np.concatenate(held))
                held = []
            held.append(pieces[0])
            for piece in pieces[1:]:
                out += edges(np.concatenate(held))
                held = [piece]
            if out:
                yield batch_of(out)
        out = edges(np.concatenate(held)) if held else []
        if out:
            yield batch_of(out)

    return work


def _shard(quarter, depth: int = SHALLOW):
    """The leaf of the upper tree: the quarter's distances from the first vantage points, as one number."""
    code = F.lit(0).cast("long")
    for v in VANTAGE[:depth]:
        code = code * 17 + F.bit_count(quarter.bitwiseXOR(F.lit(v).cast("long")))
    return code


@functools.lru_cache(maxsize=1)
def _leaves() -> list[int]:
    """Leaves of the upper tree of a quarter, by depth."""
    code = np.zeros(1 << 16, np.int64)
    out = [1]
    for v in VANTAGE:
        code = code * 17 + np.bitwise_count(np.arange(1 << 16) ^ v)
        out.append(len(np.unique(code)))
    return out


def depth_for(n: int) -> int:
    """Vantage points so that shards of n evenly spread nodes hold about SHARD_NODES; all of them beyond that."""
    return next((d for d in range(SHALLOW, len(VANTAGE)) if n <= SHARD_NODES * _leaves()[d]), len(VANTAGE))


def links(nodes: DataFrame, radius: int = 4, words: int = 1, apart: int | None = None, forest: bool = True, depth: int = SHALLOW) -> DataFrame:
    """Edges (a, b) of ids whose components are those of all pairs of nodes within radius bits in any of their words.

    nodes: id, w0, w1 ... (64-bit words of a fingerprint), ids unique. With ``apart``, pairs must besides differ in
    at most so many bits of all words together. radius < 8. Of two words within radius, some quarter of 16 bits
    differs in at most radius // 4 bits (one, for 4). So there is a tree for each quarter. Its upper levels are the
    same everywhere: the shard of a point is its quarter's distances from ``depth`` fixed vantage points (see
    ``depth_for``). By the triangle inequality a neighbour's distances differ by at most that allowance, so as a query a word visits its own shard
    and those across the boundary that clearing one bit can reach; of two quarters one bit apart, one reaches the
    other so. In a shard a vantage-point tree over whole words gives the exact pairs; of these a spanning forest
    goes on, so no shard emits more rows than it got, however many near copies it holds. Without ``forest`` all pairs
    do, some more than once.
    """
    if not 0 <= radius < 2 * QUARTERS:
        raise ValueError("radius must be below 8")
    names = [f"w{i}" for i in range(words)]
    parts = nodes.select("id", *names, F.explode(F.array(*[F.lit(i) for i in range(QUARTERS * words)])).alias("tree"))
    word = F.element_at(F.array(*names), F.floor(F.col("tree") / QUARTERS).cast("int") + 1)
    parts = parts.select("id", *names, "tree", F.call_function("shiftrightunsigned", word, (F.col("tree") % QUARTERS) * 16).bitwiseAND(F.lit(0xFFFF)).alias("quarter"))
    bits = F.array(F.lit(0).cast("long"), *([F.lit(1 << i).cast("long") for i in range(16)] if radius >= QUARTERS else []))
    near = F.filter(bits, lambda x: F.col("quarter").bitwiseAND(x) == x)
    visits = parts.select("id", *names, "tree", "quarter", F.explode(F.array_distinct(F.transform(near, lambda x: _shard(F.col("quarter").bitwiseXOR(x), depth)))).alias("shard"))
    visits = visits.select("tree", "shard", (F.col("shard") == _shard(F.col("quarter"), depth)).cast("int").alias("home"), "id", *names)
    sharded = visits.repartition("tree", "shard").sortWithinPartitions("tree", "shard")
    return map_arrow(sharded, _forests(radius, words, apart, forest), "a long, b long")


def near_groups(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, bits, component_id): component_id is the smallest id reachable over links between fingerprints.

    Equal fingerprints stand as one while links are sought, so copies cost nothing. Null or wordless texts have
    fingerprint 0 and link like others. Null ids belong to their component but never name it, unless no id does.
    Repeated ids keep a row each. No rows: no rows. Other columns of docs are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash")

    def names() -> DataFrame:
        first = written(prints.groupBy("bits").agg(F.min("id").alias("first")), "simhash-firsts")
        nodes = first.select(F.col("bits").alias("id"), F.col("bits").alias("w0"))
        joined = components(links(nodes, radius, depth=depth_for(first.count())), "simhash-links")
        group = first.join(joined.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
        name = group.groupBy("component").agg(F.min("first").alias("component_id"))
        return group.join(name, "component").select("bits", "component_id")

    named = settled(names, "simhash-names")
    return prints.join(named, "bits").select(F.col("id").alias(id_col), "bits", "component_id")


def _majorities(hashes: np.ndarray, words: int) -> np.ndarray:
    """_majority of _mixed(hashes, k) for each k < words: bits are counted in the eight bytes of a number at once."""
    ones = np.zeros((words, 64), np.int64)
    low = np.uint64(0x0101010101010101)
    for at in range(0, len(hashes), 255):
        some = np.stack([_mixed(hashes[at : at + 255], k) for k in range(words)])
        for j in range(8):
            sums = ((some >> np.uint64(j)) & low).sum(axis=1, dtype=np.uint64)
            ones[:, j::8] += sums.astype("<u8").view(np.uint8).reshape(words, 8)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


#: Bits of a block.
BLOCK = 16
#: Words whose bits are compared for rows that share a block, of how many they may differ in, and of sets of fewer than SHORT
#: shingles: for all documents, and for the few that are left after the first round.
FIRST, LATER = (4, 58, 72), (24, 300, 344)
#: Sets of fewer shingles differ in more bits at the same similarity.
SHORT = 9


#: Rows of a block up to which all near pairs go on, as they are few.
SMALL = 8


def _earlier(rows: np.ndarray, apart: int, every: bool, sizes: np.ndarray | None = None, similarity: float = 0.0, short_apart: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (earlier id, later id) within whole blocks of rows (block, id, words) sorted by block and id.

    Without ``every``, of a block of more than SMALL rows only a spanning forest of them. With ``sizes``, two sets of
    sizes that alone rule out the similarity aren't near, ``short_apart`` is the bound for sets of fewer than SHORT, and a pair
    that shares an earlier block of the words at hand is left to that block.
    """
    bits = np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
    cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))
    left = np.repeat(ends, ends - starts) - np.arange(len(rows)) - 1
    large = ends - starts > SMALL

    def near(x, y):
        differ = bits[x] ^ bits[y]
        count = np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)
        if sizes is None:
            return count <= apart
        least, most = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
        met = (count <= np.where(least < SHORT, short_apart, apart)) & (least >= similarity * most)
        at = np.flatnonzero(met)
        if len(at):
            equal = differ[at].view("<u2") == 0
            block = rows[y[at], :1] >> BLOCK
            met[at] = ~(equal & (np.arange(equal.shape[1]) < block)).any(axis=1)
        return met

    ask = np.flatnonzero((left > 0) & ~np.repeat(large, ends - starts))
    for step in range(1, SMALL):
        ask = ask[left[ask] >= step]
        if not len(ask):
            break
        x = ask[near(ask, ask + step)]
        yield rows[x, 1], rows[x + step, 1]
    for start, end in zip(starts[large], ends[large]):
        rest = np.arange(start, end)
        if every:
            for x in rest[:-1]:
                y = np.arange(x + 1, end)
                y = y[near(x, y)]
                yield np.full(len(y), rows[x, 1]), rows[y, 1]
            continue
        # Each row that a tree has got asks those that no tree has.
        while len(rest) > 1:
            turn, rest = [rest[0]], rest[1:]
            while turn and len(rest):
                x = turn.pop()
                met = near(x, rest)
                y, rest = rest[met], rest[~met]
                turn += y.tolist()
                yield np.minimum(rows[x, 1], rows[y, 1]), np.maximum(rows[x, 1], rows[y, 1])


def _block_pairs(apart: int, every: bool, similarity: float, short_apart: int):
    def pairs(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        rows = np.concatenate(held)
        for pair in _earlier(rows[:, :-1], apart, every, rows[:, -1], similarity, short_apart):
            out.append(pair)
            n += len(pair[0])
            if n >= PAIRS:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b"])
                out, n = [], 0
        if n:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            # Blocks are compared some thousand rows at a time; the last may go on in the next batch.
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if n + last >= PAIRS and (last or held[-1][-1, 0] != rows[0, 0]):
                yield from pairs([*held, rows[:last]])
                held, n, rows = [], 0, rows[last:]
            held.append(rows)
            n += len(rows)
        if held:
            yield from pairs(held)

    return work


def block_links(nodes: DataFrame, words: int, every: bool, similarity: float, bounds: tuple[int, int, int] = FIRST) -> DataFrame:
    """Pairs (a, b), a < b, of ids of nodes (id, n, w0, w1 ...) that are equal in a block of 16 bits of any word, differ in
    few enough bits of the first words (see FIRST), and whose numbers n of shingles allow the similarity; some come more than once.

    Without ``every``, their components are those of all pairs, but of large shards only a forest goes on. A node goes to one shard a block,
    and shards hold one node in 65,536 of a corpus without near copies.
    """
    checked, apart, short_apart = bounds
    made = [((F.lit(k).cast("long") * (1 << BLOCK)) + F.call_function("shiftrightunsigned", F.col(f"w{k // 4}"), F.lit(k % 4 * BLOCK)).bitwiseAND(F.lit((1 << BLOCK) - 1))) for k in range(words * 64 // BLOCK)]
    rows = nodes.select(F.explode(F.array(*made)).alias("block"), "id", *[f"w{i}" for i in range(min(words, checked))], "n")
    sharded = rows.repartition("block").sortWithinPartitions("block", "id")
    return map_arrow(sharded, _block_pairs(apart, every, similarity, short_apart), "a long, b long")


def _sketches(shingle: int, words: int):
    names = ["key", "whole", "s1", "s2", "n", *[f"w{i}" for i in range(words)]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.empty((3 + words, len(batch)), dtype=np.uint64)
            for i, text in enumerate(batch.column(2)):
                hashes = _hashes(text.as_py() or b"", shingle)
                whole = np.unique(hashes)  # as the similarity, so repeats must not outweigh the rest
                made[:2, i] = [xxhash.xxh64_intdigest(whole.tobytes(), seed) for seed in (1, 2)]
                made[2, i] = len(whole)
                made[3:, i] = _majorities(whole, words)
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(m.view(np.int64)) for m in made]], names)

    return work


def _shingle_sets(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(_hashes(text.as_py() or b"", shingle)).view(np.int64) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["id", "shingles"])

    return work


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, alike) of pairs of ids."""
    met = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("own")), "b")
    met = met.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("head")), "a")
    shared = F.size(F.array_intersect("own", "head"))
    alike = shared >= similarity * (F.size("own") + F.size("head") - shared)
    return met.select("a", "b", alike.alias("alike"))


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 24) -> DataFrame:
    """docs without the near copies of others: those of a Jaccard similarity of word shingles of ``similarity`` or
    more to a document that stays.

    Documents of the same set of shingles are one, the smallest id. The others' fingerprints have ``words`` words of
    64 bits; documents equal in one of their blocks of 16 bits, within 58 of the 256 bits of the first four words and of numbers of
    shingles that allow the similarity are linked (72 bits for those of fewer than nine shingles, of which one more or less
    changes more bits). At a similarity of 0.8 a bit differs with a chance of 0.15, so one of 96 blocks is equal for all but
    one pair in 1,000, and about as few differ in more bits. In each of two rounds the smallest
    id of each component stays, and its members are compared with it: the alike go, the others go on without it. By then
    groups of near copies are gone, and all linked pairs of what is left are compared, by then within 300 of all 1,536 bits; there those go that are alike to an
    earlier one that stays. So of two alike, linked documents one goes, whatever chains lead through their group, and each
    goes for one that stays.

    Texts without words have no shingles and count as alike. Rows are told apart by id and text, so those that share
    an id, or have none, are compared like others; null ids come first among exact copies, and of near copies those
    rows are in the order of a hash. Of rows equal in both one stays. No rows: no rows. Other columns are kept.
    """
    lowest = F.lit(-(1 << 63))
    key = F.coalesce(F.col(id_col).cast("long"), lowest)
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(key.alias("key"), F.xxhash64(data).alias("whole"), data.alias("data"))
    lost = settled(lambda: _lost(rows, shingle, similarity, words), "simhash-lost").toDF("__key", "__gone")
    known = docs.withColumns({"__id": key, "__whole": F.xxhash64(data)})
    left = known.join(lost, (F.col("__id") == F.col("__key")) & (F.col("__whole") == F.col("__gone")), "left_anti")
    return left.dropDuplicates(["__id", "__whole"]).drop("__id", "__whole")


def _lost(rows: DataFrame, shingle: int, similarity: float, words: int) -> DataFrame:
    """(key, whole) of the rows (key, whole, data) that one_each leaves out."""
    lowest = F.lit(-(1 << 63))
    names = ["n", *[f"w{i}" for i in range(words)]]
    prints = written(map_arrow(rows, _sketches(shingle, words), "key long, whole long, s1 long, s2 long, " + ", ".join(f"{n} long" for n in names)), "simhash-sketches")
    firsts = prints.groupBy("s1", "s2").agg(F.min(F.struct("key", "whole", *names)).alias("first")).select("s1", "s2", "first.*")
    # The node of a document is its id; where that is null or shared, the hash of its shingles.
    shared = prints.select("key", "whole").distinct().groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("shared"))
    own = F.col("shared").isNull() & (F.col("key") != lowest)
    firsts = written(firsts.join(shared, "key", "left").withColumn("id", F.when(own, F.col("key")).otherwise(F.col("s1"))).drop("shared"), "simhash-firsts")
    copies = prints.join(firsts.select("s1", "s2", F.col("key").alias("first_key"), F.col("whole").alias("first_whole")), ["s1", "s2"])
    copies = copies.where((F.col("key") != F.col("first_key")) | (F.col("whole") != F.col("first_whole"))).select("key", "whole")
    gone = []
    live = firsts.select("id", *names)
    place = firsts.select("id", "key", "whole")

    sets = None
    for bounds in (FIRST, LATER):
        found = components(block_links(live, words, False, similarity, bounds), "simhash-links")
        if sets is None:
            asked = rows.join(place.join(found.select(F.col("node").alias("id")), "id", "left_semi"), ["key", "whole"]).select("id", "data")
            sets = written(map_arrow(asked, _shingle_sets(shingle), "id long, shingles array<long>").dropDuplicates(["id"]), "simhash-sets")
        met = written(_compared(found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")), sets, similarity), "simhash-met")
        gone.append(met.where("alike").select(F.col("b").alias("id")))
        live = written(live.join(met.where("not alike").select(F.col("b").alias("id")), "id", "left_semi"), "simhash-live")
    pairs = written(block_links(live, words, True, similarity, LATER).distinct(), "simhash-left")
    edges = written(_compared(pairs, sets, similarity).where("alike").select("a", "b"), "simhash-pairs")
    while not edges.isEmpty():
        stay = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        out = written(edges.join(stay, "a").select(F.col("b").alias("id")).distinct(), "simhash-out")
        gone.append(out)
        edges = written(edges.join(out, edges["a"] == out["id"], "left_anti").join(out, edges["b"] == out["id"], "left_anti"), "simhash-pairs")
    near = place.join(functools.reduce(DataFrame.union, gone).distinct(), "id", "left_semi").select("key", "whole")
    return copies.union(near).distinct()


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
