"""Packing token streams into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow

#: Characters whose tokens depend neither on Unicode tables nor on the text around their run of non-spaces.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ſ‐-‧‰-⁞]")
#: Words as the tokenizer's own pattern cuts them, for these characters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class WordCache:
    """Ids of whole texts; runs of non-spaces and the words in them are encoded once and remembered.

    A tokenizer of the word kind splits at white space and lower-cases first, so a run's ids don't depend on its
    neighbours. Texts with other characters than common Latin ones go through the tokenizer as a whole. Runs and words
    share one table, since a word by itself is a run of the same ids; it is emptied when it holds more than most.
    """

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.known = most, {}
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, runs: list[str]) -> None:
        """Add runs to the table. New words go to the tokenizer in one text; a word's last token is one that closes words."""
        known = self.known
        split = list(map(_WORD.findall, runs))
        new = list({w for some in split for w in some}.difference(known))
        for i in range(0, len(new), 2_000):
            some = new[i : i + 2_000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.closing[ids]) + 1).tolist()
            for word, start, end in zip(some, [0, *ends], ends, strict=False):
                known[word] = ids[start:end].tobytes()
            if len(ends) != len(some):
                raise ValueError("a word has no last token: the tokenizer is not of the word kind")
        for run, some in zip(runs, split):
            if run not in known:
                known[run] = b"".join(map(known.__getitem__, some))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if "<|" in text or _PLAIN.search(text):
            return self.whole([text])[0]
        runs = text.lower().split()
        known = self.known
        found = list(map(known.get, runs))
        if None in found:
            self.learn(list({r for r, f in zip(runs, found) if f is None}))
            found = [known[r] if f is None else f for r, f in zip(runs, found)]
            if len(known) > self.most:
                known.clear()
        return b"".join(found)


@functools.lru_cache(maxsize=2)
def worker_cache(path: str) -> WordCache:
    """One for each Python worker, which serves many tasks."""
    return WordCache(path)


def differencing(sizes: list[int], windows: int) -> tuple[list[list[int]], list[int]]:
    """Karmarkar-Karp over many windows: groups of positions in sizes, and their sums.

    Every item starts as a partition of its own, one window holding it and the others none. The two partitions with
    the widest spread are merged, the fullest window of one with the emptiest of the other, until one is left.
    """
    if not sizes:
        return [[] for _ in range(windows)], [0] * windows
    if windows == 1:
        return [list(range(len(sizes)))], [sum(sizes)]
    # A partition: sums in descending order, less their minimum, and a node of the merge tree for each window.
    # Node n < len(sizes) is an item; others are pairs; -1 is empty.
    pairs: list[tuple[int, int]] = []
    first = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(windows, dtype=np.int64), np.full(windows, -1, dtype=np.int64)
        sums[0], nodes[0] = s, i
        heap.append((-s, i, sums, nodes, 1))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, an, af = heapq.heappop(heap)
        _, _, b, bn, bf = heapq.heappop(heap)
        sums = a.copy()
        sums[windows - bf :] += b[:bf][::-1]
        nodes = an.copy()
        for j in range(bf):  # windows of b that hold something meet the emptiest of a
            at, other = windows - 1 - j, int(bn[j])
            if other >= 0:
                if nodes[at] < 0:
                    nodes[at] = other
                else:
                    pairs.append((int(nodes[at]), other))
                    nodes[at] = first + len(pairs) - 1
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums -= sums[-1]
        held = int((nodes >= 0).sum())
        # Windows with nodes stand first: those without have sum 0 and come last; zero-size ties keep their order.
        if held < windows and (nodes[:held] < 0).any():
            order = np.argsort(nodes < 0, kind="stable")
            sums, nodes = sums[order], nodes[order]
        count += 1
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), count, sums, nodes, held))
    groups = []
    for n in heap[0][3]:
        out, stack = [], [int(n)] if n >= 0 else []
        while stack:
            x = stack.pop()
            if x < first:
                out.append(x)
            else:
                stack.extend(pairs[x - first])
        groups.append(sorted(out))
    return groups, [sum(sizes[i] for i in g) for g in groups]


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most capacity each, by differencing; one window more whenever one would overflow."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        groups, sums = differencing(sizes, windows)
        if max(sums) <= capacity:
            return [g for g in groups if g]
        windows += 1


def _packer(path: str, capacity: int, end_id: int, group_windows: int, largest_piece: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        pieces: list[tuple[int | None, int, bytes, int]] = []
        held = 0
        out: dict[str, list] = {k: [] for k in ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        waiting = 0

        def put(doc, start, ids, total, seq, offset):
            nonlocal waiting
            for k, v in zip(out, (doc, start, len(ids) // 4, ids, total, seq, offset)):
                out[k].append(v)
            waiting += len(ids)

        def flush():
            nonlocal held, next_id
            for group in near_equal([len(p[2]) // 4 for p in pieces], capacity) if pieces else []:
                offset = 0
                for i in group:
                    doc, start, ids, total = pieces[i]
                    put(doc, start, ids, total, next_id, offset)
                    offset += len(ids) // 4
                next_id += 1
            pieces.clear()
            held = 0

        def ready():
            nonlocal waiting
            batch = pa.record_batch([pa.array(out["id"], pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["ids"], pa.binary()), pa.array(out["doc_tokens"], pa.int64()), pa.array(out["sequence_id"], pa.int64()), pa.array(out["offset"], pa.int64())], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            for v in out.values():
                v.clear()
            waiting = 0
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = cache.encode(text.as_py() or "") + end
                total = len(ids) // 4
                full = total // capacity * capacity
                for start in range(0, full, capacity):
                    put(doc, start, ids[4 * start : 4 * (start + capacity)], total, next_id, 0)
                    next_id += 1
                for start in range(full, total, largest_piece):
                    pieces.append((doc, start, ids[4 * start : 4 * min(start + largest_piece, total)], total))
                    held += min(largest_piece, total - start)
                if held >= group_windows * capacity:
                    flush()
                if waiting > 8 << 20:
                    yield ready()
        flush()
        if waiting:
            yield ready()

    return work


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_windows: int = 128, largest_piece: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut documents into pieces and lay these into windows of at most capacity tokens.

    One row a piece: the id, start (the document's tokens before it), length, ids (binary, little-endian unsigned
    32-bit), doc_tokens (with end_id, which closes each document), sequence_id, offset (in the window, gapless).
    Whole windows are cut from long documents first; the remainders, in pieces of up to largest_piece, are gathered
    to some group_windows windows and dealt by Karmarkar-Karp differencing into the fewest near-equal windows; where
    one would overflow, the group gets a window more. A group leaves less than two windows of padding.

    There is no shuffle: each task packs what it scans, holds one group at a time, and numbers windows from its
    partition, so a task that runs again gives the same rows. Null or empty text: end_id alone. Null ids and repeated
    ids are packed like others. No rows: no rows. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = map_arrow(rows, _packer(tokenizer_path, capacity, end_id, group_windows, largest_piece), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
