"""Benchmark decontamination by embedded edit distance.

An item leaks into a text if some stretch of the text is within ``ratio`` of
the item's words of it, counted in word edits.  Five steps find these stretches:

1. a stretch within k edits of an item keeps all but 2k of its word pairs, so
   windows with fewer pairs known from items of their size are left out;
2. the random walk of Chakraborty, Goldenberg and Koucky embeds the remaining item-sized
   windows and the items, turning edits into Hamming distance;
3. repeated bit samples of the embeddings are looked up in the items' hash tables;
   repetitions follow from a target recall at a Hamming distance;
4. edited passages, longer ones above all, may be further apart than that: so places where
   enough of one item's own pairs are close together are candidates, too, and nothing is missed;
5. candidates are verified by exact (bit-parallel) edit distance.

Words are lower-cased and cut at ASCII punctuation.  The benchmark is taken in blocks of
bounded number and size of items, each sent to all tasks; texts are never shuffled.  With several blocks each is
finished and written before the next is sent.

Items of fewer than ``least`` words leak where a text has all their words in sequence, without edits;
they are looked up as they are.  Null and empty texts or items, or items without a word, give nothing.  Equal items are each reported, but a repeated row of
the benchmark counts once; repeated documents report again; other columns are ignored, whatever their names.
A very long item is searched as any other: what is held of windows is bounded by their number times their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import Workspace, load, small_batches

SCHEMA = "doc_id long, item_id long, distance long, item_words long, first_word long, last_word long"
#: Items sent to the tasks at once, and their characters together; a longer item is a block of its own.
BLOCK, CHARACTERS = 4096, 4 << 20
#: Numbers held at once of the walks over windows.
HELD = 1 << 22
WALKS, SAMPLE = 4, 6
SEED = 4711
CUT = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(CUT).split()


def repetitions(recall: float, hamming: float, sample: int = SAMPLE) -> int:
    """So many samples that two embeddings at a relative Hamming distance agree on one of them with probability ``recall``."""
    return ceil(log(1 - recall) / log(1 - (1 - hamming) ** sample))


class Embedding:
    """The walks, and the positions that are sampled from them."""

    def __init__(self, longest: int, times: int):
        r = np.random.Generator(np.random.PCG64(SEED))
        self.steps = 2 * longest  # as far as samples reach
        self.bits = r.integers(0, 1 << 63, (WALKS, self.steps), np.int64).astype(np.uint64) | np.uint64(1)
        self.at = r.random((times, SAMPLE))
        self.mix = r.integers(0, 1 << 63, (times, SAMPLE), np.int64).astype(np.uint64) | np.uint64(1)

    def keys(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(times, rows): sampled keys of strings ``x`` (rows x longest, zeros behind ``sizes``)."""
        n, longest = x.shape
        ends = np.hstack([x, np.zeros((n, 1), x.dtype)]).astype(np.uint64)
        row, i = np.arange(n), np.zeros((WALKS, n), np.int64)
        # the walk is at half speed: samples are from the steps before it is expected to end
        walk = np.empty((WALKS, 2 * longest, n), np.uint64)
        for j in range(2 * longest):
            s = ends[row, i]
            walk[:, j] = s
            step = ((s + np.uint64(1)) * self.bits[:, j, None]) >> np.uint64(41) & np.uint64(1)
            i = np.minimum(i + step.astype(np.int64), sizes)
        place = (self.at[:, :, None] * (2 * sizes)).astype(np.int64)
        keys = np.empty((len(self.at), n), np.uint64)
        for t in range(len(self.at)):
            key = sizes.astype(np.uint64) * np.uint64(1000003) + np.uint64(t)
            for c in range(SAMPLE):
                key = (key ^ walk[t % WALKS, place[t, c], row]) * self.mix[t, c]
                key ^= key >> np.uint64(29)
            keys[t] = key
        return keys


def portions(sizes: np.ndarray):
    """(first, end) of runs of ascending sizes whose walks together are at most ``HELD`` numbers, or one."""
    i = 0
    while i < len(sizes):
        low, high = i + 1, len(sizes)
        while low < high:  # the longest run
            j = (low + high + 1) // 2
            if (j - i) * 2 * WALKS * int(sizes[j - 1]) <= HELD:
                low = j
            else:
                high = j - 1
        yield i, low
        i = low


def search(text: list[int], item: list[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, and the end of the first such stretch (Myers)."""
    m, every = len(item), (1 << len(item)) - 1
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    plus, minus, score, best, end, top = every, 0, m, m, 0, 1 << m - 1
    for j, w in enumerate(text, 1):
        eq = places.get(w, 0)
        x = eq | minus
        d = ((eq & plus) + plus ^ plus) | eq
        up, down = (minus | ~(d | plus)) & every, plus & d
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & every, down << 1 & every
        plus, minus = (down | ~(x | up)) & every, up & x
        if score < best:
            best, end = score, j
    return best, end


def matched(text: list[int], item: list[int]) -> tuple[int, int, int]:
    """(distance, first, end) of the closest stretch."""
    best, end = search(text, item)
    _, back = search(text[:end][::-1], item[::-1])
    return best, end - back, end


class Items:
    """What a task needs to know of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], ratio: float, least: int, times: int):
        every = [(i, w) for i, t in rows if (w := words(t))]
        listed, short = [x for x in every if len(x[1]) >= least], [x for x in every if len(x[1]) < least]
        self.ids = [i for i, _ in listed + short]
        self.number: dict[bytes, int] = {}
        for _, w in listed + short:
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
        self.texts = [[self.number[x] for x in w] for _, w in listed + short]
        self.edits = [int(ratio * len(x)) for x in self.texts]
        self.sizes = sorted({len(w) for _, w in listed})
        self.base = len(self.number) + 1
        # items that are looked up as they are, by size and hash
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, (_, w) in enumerate(short, len(listed)):
            t = np.array([self.number[x] for x in w], np.int64)
            self.short.setdefault(len(w), {}).setdefault(int(self.hashed(t, len(t))[0]), []).append(i)
        self.codes = {m: np.array(sorted(held), np.uint64) for m, held in self.short.items()}
        self.long = [[self.number[x] for x in w] for _, w in listed]
        # known pairs, and for each a bit for each size (mod 64) of item that has it
        sized = sorted({(a * self.base + b, self.sizes.index(len(x)) % 64) for x in self.long for a, b in zip(x, x[1:])})
        pairs = np.array([p for p, _ in sized], np.int64)
        self.pairs, first = np.unique(pairs, return_index=True)
        bits = np.uint64(1) << np.array([b for _, b in sized], np.uint64)
        self.bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        # the items of each pair, by size and pair
        own = sorted({(self.sizes.index(len(t)), a * self.base + b, i) for i, t in enumerate(self.long) for a, b in zip(t, t[1:])})
        self.sized = [np.array([x[1:] for x in own if x[0] == c], np.int64).reshape(-1, 2) for c in range(len(self.sizes))]
        if listed:
            self.embedding = Embedding(self.sizes[-1], times)
            by_size = np.array(sorted(range(len(listed)), key=lambda i: len(self.long[i])))
            sizes = np.array([len(self.long[i]) for i in by_size])
            keys, owner = [], []
            for i, j in portions(sizes):
                x = np.zeros((j - i, sizes[j - 1]), np.int64)
                for r, item in enumerate(by_size[i:j]):
                    x[r, : sizes[i + r]] = self.long[item]
                keys.append(self.embedding.keys(x, sizes[i:j]).ravel())
                owner.append(np.tile(by_size[i:j], times))
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(keys, kind="stable")
            self.keys, self.owner = keys[order], owner[order]

    @staticmethod
    def hashed(x: np.ndarray, m: int) -> np.ndarray:
        """Hashes of all stretches of m words."""
        n = len(x) - m + 1
        h = np.zeros(n, np.uint64)
        for j in range(m):
            h = (h ^ x[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def whole(self, x: np.ndarray):
        """(item, place) of the short items in ``x``, in order of places."""
        for m, held in self.short.items():
            if len(x) < m:
                continue
            h, codes = self.hashed(x, m), self.codes[m]
            for i in np.flatnonzero(codes[np.minimum(np.searchsorted(codes, h), len(codes) - 1)] == h).tolist():
                for item in held[int(h[i])]:
                    if self.texts[item] == x[i : i + m].tolist():
                        yield item, i

    def dense(self, c: int, q: np.ndarray, pair: np.ndarray, have: np.ndarray, width: int, enough: int):
        """(item, place) from which ``enough`` of the pairs of an item of the c-th size follow within ``width``.

        q, pair: places and pairs known from items of that size; have: how many follow each place."""
        edge = np.zeros(len(q) + 1, np.int64)
        begin = np.flatnonzero(have >= enough)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + have[begin], -1)
        inside = np.cumsum(edge[:-1]) > 0
        q, pair = q[inside], pair[inside]
        held, owner = self.sized[c].T
        low, high = np.searchsorted(held, pair, "left"), np.searchsorted(held, pair, "right")
        n = high - low
        item = owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        at = np.repeat(q, n)
        room = int(q[-1]) + width + 1 if len(q) else 1
        key = np.sort(item * room + at)
        many = np.searchsorted(key, key + width) - np.arange(len(key)) >= enough
        return zip((key[many] // room).tolist(), (key[many] % room).tolist())

    def gap(self, ratio: float) -> int:
        """Words between two texts in a row that no window bridges with a known pair."""
        longest = self.sizes[-1] if self.sizes else max(self.short, default=0)
        return longest + int(ratio * longest) + 1

    def find(self, texts: list[list[bytes]], ratio: float):
        """(text, item, distance, first, end) of every leak in ``texts``."""
        gap = self.gap(ratio)
        # all texts in one row, with gaps that no window bridges with a known pair
        at, parts = [], []
        n = 0
        for t in texts:
            at.append(n)
            x = np.zeros(len(t) + gap, np.int64)
            x[: len(t)] = np.fromiter(map(self.number.get, t, [0] * len(t)), np.int64, len(t))
            parts.append(x)
            n += len(x)
        x = np.concatenate(parts)
        first = np.array(at)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item, s in self.whole(x):
            doc = int(np.searchsorted(first, s, "right")) - 1
            best.setdefault((doc, item), (0, s - at[doc], s - at[doc] + len(self.texts[item])))
        if self.sizes:
            self.edited(x, at, [len(t) for t in texts], ratio, best)
        for (doc, item), got in sorted(best.items()):
            yield (doc, item, *got)

    def edited(self, x: np.ndarray, at: list[int], lengths: list[int], ratio: float, best: dict) -> None:
        """Adds what is found of the long items to ``best``; texts of these lengths begin in ``x`` at these places."""
        longest = self.sizes[-1]
        both = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
        pair = x[both] * self.base + x[both + 1]
        near = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = self.pairs[near] == pair
        place, bits, pair = both[known], self.bits[near[known]], pair[known]
        hits: set[tuple[int, int]] = set()
        starts, sizes = [], []
        for c, m in enumerate(self.sizes):
            k = int(ratio * m)
            mine = (bits >> np.uint64(c % 64) & np.uint64(1)).astype(bool)
            q = place[mine]
            have = np.searchsorted(q, q + (m + k - 1)) - np.arange(len(q))
            # a leak's first known pair is followed by all its others; up to k of its words may precede it
            enough = max(1, m - 1 - 2 * k)
            p = q[have >= enough]
            if len(p):
                hits.update(self.dense(c, q, pair[mine], have, m + k - 1, enough))
                p = np.unique(np.maximum(p[:, None] - np.arange(k + 1)[None, :], 0))
                starts.append(p)
                sizes.append(np.full(len(p), m))
        if not starts:
            return
        p, m = np.concatenate(starts), np.concatenate(sizes)
        padded = np.concatenate([x, np.zeros(longest, np.int64)])
        for i, j in portions(m):
            a, b = p[i:j], m[i:j]
            inside = np.arange(b[-1])[None, :]
            flat = self.embedding.keys(np.where(inside < b[:, None], padded[a[:, None] + inside], 0), b).ravel()
            low, high = np.searchsorted(self.keys, flat, "left"), np.searchsorted(self.keys, flat, "right")
            for k in np.flatnonzero(high > low):
                hits.update((int(self.owner[o]), int(a[k % len(a)])) for o in range(low[k], high[k]))
        first = np.array(at)
        spans: list[list[int]] = []
        for item, s in sorted(hits):
            size, k = len(self.texts[item]), self.edits[item]
            doc = int(np.searchsorted(first, s, "right")) - 1
            a, b = max(at[doc], s - 2 * k), min(at[doc] + lengths[doc], s + size + 2 * k)
            if spans and spans[-1][:2] == [item, doc] and a <= spans[-1][3]:
                spans[-1][3] = max(b, spans[-1][3])
            else:
                spans.append([item, doc, a, b])
        for item, doc, a, b in spans:
            d, s, e = matched(x[a:b].tolist(), self.texts[item])
            if d <= self.edits[item]:
                got = (d, s + a - at[doc], e + a - at[doc])
                best[doc, item] = min(got, best.get((doc, item), got))


def blocks_of(benchmark: DataFrame, size: int = BLOCK, characters: int = CHARACTERS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most so many rows and characters, but for an item that is longer by itself; the driver holds a block at a time."""
    held, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().toLocalIterator():
        more = len(row["text"] or "")
        if held and (len(held) == size or n + more > characters):
            yield held
            held, n = [], 0
        held.append(tuple(row))
        n += more
    yield held


def one_by_one(benchmark: DataFrame) -> Iterator[tuple[int, bool, Broadcast]]:
    """(number, whether it is the only one, broadcast) of each block."""
    sc, blocks = benchmark.sparkSession.sparkContext, blocks_of(benchmark)
    now, b = next(blocks), 0
    while now is not None:
        after = next(blocks, None)
        yield b, not b and after is None, sc.broadcast(now)
        now, b = after, b + 1


def found_in(texts, known: Items, ratio: float):
    """(row, item, distance, first, end) of leaks in an Arrow column of texts."""
    held: list[list[bytes]] = []
    done, n = 0, 0
    for i, text in enumerate(texts):
        held.append(words(text.as_py()))
        n += len(held[-1]) + known.gap(ratio)
        if n > 400_000 or i == len(texts) - 1:
            for d, *rest in known.find(held, ratio):
                yield (done + d, *rest)
            done, n, held = i + 1, 0, []


def leaks(docs: DataFrame, benchmark: DataFrame, *, ratio: float = 0.15, least: int = 8, recall: float = 0.99, hamming: float = 0.25) -> DataFrame:
    """One row for each text of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it holds."""
    small_batches(docs.sparkSession)
    times = repetitions(recall, hamming)

    def of_block(shared) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            known = Items(shared.value, ratio, least, times)
            titles = [x.split()[0] for x in SCHEMA.split(", ")]
            for batch in batches:
                if known.ids and batch.num_rows:
                    names = batch.column(0).to_pylist()
                    out = [(names[d], known.ids[item], k, len(known.texts[item]), s, e - 1) for d, item, k, s, e in found_in(batch.column(1), known, ratio)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(len(titles))], titles)

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)

    work, parts = Workspace(docs.sparkSession, "leaks"), []
    for b, only, shared in one_by_one(benchmark):
        if only:
            return of_block(shared)
        work.table(of_block(shared), f"block-{b}")
        parts.append(work.sub(f"block-{b}"))
        shared.destroy()
    return docs.sparkSession.read.schema(SCHEMA).parquet(*parts)


def filtered(docs: DataFrame, benchmark: DataFrame, *, ratio: float = 0.15, least: int = 8, recall: float = 0.99, hamming: float = 0.25) -> DataFrame:
    """The rows of ``docs`` (text, ...) that hold no item, with all their columns; nothing is shuffled."""
    small_batches(docs.sparkSession)
    times = repetitions(recall, hamming)
    at = docs.columns.index("text")

    def without(frame: DataFrame, shared) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            known = Items(shared.value, ratio, least, times)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                if known.ids:
                    for row, *_ in found_in(batch.column(at), known, ratio):
                        keep[row] = False
                yield batch.filter(pa.array(keep))

        return frame.mapInArrow(run, frame.schema)

    work = Workspace(docs.sparkSession, "clean")
    for b, only, shared in one_by_one(benchmark):
        if only:
            return without(docs, shared)
        docs = work.table(without(docs, shared), f"block-{b}")
        shared.destroy()
        if b:
            work.drop(f"block-{b - 1}")
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of the benchmark into all documents."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
