"""Language-model scoring by a hashed maximum-entropy model.

P(token | history) = P(class | history) * P(token | class, history).  Both factors are
softmaxes over hashed features of the history: the last word, the last two, and
the words two and three back (skips).  The most frequent words fill classes of
32 and are told apart by the second softmax, a word after one step.  Other words with ``LEARNT``
occurrences are the leaves of trees of 32 branches a node, whose roots are further classes: the second
softmax is taken at each node on the way.  All other words fall into classes by
their last letters, where the share of a word is its add-one count.

Counts cover all training documents.  Training runs over all of them once, in
rounds: learners start a round from the same weights, update them on their own
documents in batches (AdaGrad), and the changes are averaged by rows of
weights through a shuffle.  Words in trees and named in histories grow with the words
that are frequent enough, up to ``FREQUENT``; rows of weights grow with the root of the
number of tokens.  Both are broadcast; counts of rarer words are joined.

A null text counts as empty: one end token.  Documents are told apart by a row
number, so repeated rows are scored, and counted, each.  A document
without doc_id is trained on.  On an empty table the result is empty; without
training tokens every score is that of the untrained model.
"""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import Workspace, load, small_batches

FREQUENT = 1 << 18  #: words at most whose counts are broadcast
NAMED = 1 << 13  #: words at least that stand for themselves in a history; others do by their last letters
CLASS = 32  #: words in a class of frequent words, and branches of a node
CLASSES = 16  #: classes of frequent words, as many of others, and trees at most
LEARNT = 512  #: occurrences from which a word is told from others by its history
ENDINGS = 4096
BUCKETS = 1 << 15  #: rows of weights at least
BLOCK = 512
LEARNER_TOKENS = 8_000_000
BATCH = 8192
END = b""  # no word is empty
ROUNDS = ((0, 1), (3, 4), (5, 6))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words and the end token."""
    return [*(text or "").encode().lower().split(), END]


class Powers:
    """Powers of an odd number and of its inverse, mod 2**64, as far as needed."""

    base = np.uint64(0xD6E8FEB86659FD93)
    inverse = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(size - 1, self.base, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(size - 1, self.inverse, np.uint64))])
        return self.up[:n], self.down[:n]


RUN = 1 << 17
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def tokens(texts: list[str | None], powers: Powers) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts at once: the lower-cased bytes, starts, ends, 64-bit hashes, and the text of each word.

    A word's hash is the difference of running sums, so no word is touched by itself.
    """
    parts = [(t or "").encode() for t in texts]
    return hashed(b" " + b" ".join(parts).lower() + b" ", np.array([len(p) for p in parts], np.int64), powers)


def hashed(data: bytes, sizes: np.ndarray, powers: Powers) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of lower-cased texts of these sizes, each between spaces."""
    raw = np.frombuffer(data, np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    h = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # runs of words of bounded length, which stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + RUN, "right")))
        a, b = starts[i] - 1, ends[j - 1]
        up, down = powers.get(int(b - a))
        sums = np.cumsum((raw[a:b] + np.uint64(1)) * up)
        h[i:j] = (sums[ends[i:j] - 1 - a] - sums[starts[i:j] - 1 - a]) * down[starts[i:j] - a]
        i = j
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(29)
    firsts = np.cumsum(sizes + 1) - sizes
    return data, starts, ends, h | np.uint64(1), np.repeat(np.arange(len(sizes)), np.diff(np.searchsorted(starts, np.append(firsts, len(raw)))))


def ending(word: bytes) -> int:
    return zlib.crc32(word.decode("utf-8", "replace").rstrip(".,")[-3:].encode()) % ENDINGS


class Counted:
    """Lower-cased words and their counts in arrays, so that no word is an object in the driver or in what is broadcast."""

    def __init__(self, data: bytes, sizes: np.ndarray, counts: np.ndarray):
        self.data, self.sizes, self.counts = data, sizes, counts  # each word between spaces

    @classmethod
    def of(cls, listed: Counted | list[tuple[str, int]]) -> Counted:
        if isinstance(listed, cls):
            return listed
        parts = [w.encode().lower() for w, _ in listed]
        return cls(b" " + b" ".join(parts) + b" ", np.array([len(p) for p in parts], np.int64), np.array([c for _, c in listed], np.int64))

    @classmethod
    def collected(cls, df: DataFrame) -> Counted:
        """Rows of ``df`` (word, c): the end token, then the commonest first, equally common ones by their bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = df.select("word", "c").toArrow()
        words, c = found["word"].cast(pa.large_string()), found["c"]
        del found
        order = pc.sort_indices(pa.table([pc.equal(words, END.decode()).cast(pa.int8()), c, words], ["end", "c", "word"]), [("end", "descending"), ("c", "descending"), ("word", "ascending")])
        words = pa.concat_arrays(words.chunks).take(order) if len(order) else pa.array([], pa.large_string())
        sizes = pc.binary_length(words).to_numpy()
        spaced = pc.binary_join_element_wise(words, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())).buffers()[2]
        return cls(b" " + (spaced.slice(0, int((sizes + 1).sum())).to_pybytes() if len(sizes) else b""), sizes, c.take(order).to_numpy())

    def __len__(self) -> int:
        return len(self.sizes)

    def endings(self) -> np.ndarray:
        ends = np.cumsum(self.sizes + 1)
        return np.fromiter((ending(self.data[b - n : b]) for b, n in zip(ends, self.sizes)), np.int16, len(self))


class Listed:
    """What a lexicon is built from, to be broadcast; a worker builds it once for all its tasks of a stage."""

    def __init__(self, listed: Counted, modelled: int, named: int):
        self.parts = (listed, modelled, named, listed.endings())
        self.built: Lexicon | None = None

    def __getstate__(self):
        return {"parts": self.parts, "built": None}

    def lexicon(self) -> Lexicon:
        if self.built is None:
            self.built = Lexicon(*self.parts)
        return self.built


def sizes_for(total: int, often: int) -> tuple[int, int, int]:
    """Words told apart, words named in histories and rows of weights, for so many tokens and words of ``LEARNT`` occurrences."""
    rows = BUCKETS
    while rows < 4 * total**0.5:
        rows *= 2
    return max(CLASSES * CLASS, often), max(NAMED, often), rows


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)), F.lit(0))


class Tally:
    """Counts of words by hash; their bytes stay in arrays, so that no word is touched by itself."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, data: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        h, first, n = np.unique(h, return_index=True, return_counts=True)
        self.held.append((h, n, ends[first] - starts[first], cut(np.frombuffer(data, np.uint8), starts[first], ends[first])))
        self.n += len(h)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, lengths and joined bytes of distinct words."""
        h, n, sizes, data = (np.concatenate(x) for x in zip(*self.held))
        h, first, which = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(which, n, len(h)).astype(np.int64)  # below 2**53
        ends = np.cumsum(sizes)
        data, sizes = cut(data, (ends - sizes)[first], ends[first]), sizes[first]
        self.held, self.n = [(h, n, sizes, data)], len(h)
        return n, sizes, data


def cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of several stretches, one after another."""
    sizes = ends - starts
    return raw[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def counts(docs: DataFrame) -> DataFrame:
    """(word, c) over ``docs`` (text), summed in each task before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        tally, powers, texts_n = Tally(), Powers(), 0
        schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

        def emit():
            if not tally.n:
                return
            n, sizes, data = tally.merged()
            tally.__init__()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for i in range(0, len(n), 65536):
                j = min(i + 65536, len(n))
                offsets = (ends[i : j + 1] - ends[i]).astype(np.int32)
                words = pa.StringArray.from_buffers(j - i, pa.py_buffer(offsets), pa.py_buffer(data[ends[i] : ends[j]].tobytes()))
                yield pa.RecordBatch.from_arrays([words, pa.array(n[i:j])], schema=schema)

        fresh = 0
        for batch in batches:
            for texts in portions(batch.column(0)):
                data, starts, ends, h, _ = tokens(texts, powers)
                tally.add(data, starts, ends, h)
                texts_n += len(texts)
                if tally.n > fresh + 1_000_000:
                    tally.merged()
                    fresh = tally.n
                    if fresh > 500_000:
                        yield from emit()
                        fresh = 0
        yield from emit()
        if texts_n:
            yield pa.RecordBatch.from_arrays([pa.array([END.decode()]), pa.array([texts_n], pa.int64())], schema=schema)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def portions(texts, most: int = 1 << 19):
    """Lists of texts of about ``most`` characters together; a longer text is a list of its own."""
    held, n = [], 0
    for text in texts:
        held.append(text.as_py())
        n += len(held[-1] or "")
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


class Lexicon:
    """word -> position in tables of class, slot, history hash and count; words not listed fall to their ending's position."""

    def __init__(self, listed: Counted | list[tuple[str, int]], modelled: int, named: int = NAMED, tails: np.ndarray | None = None):
        self.powers = Powers()
        self.listed = listed = Counted.of(listed)
        n = len(listed)
        self.n = n
        self.end = next(iter(np.flatnonzero(listed.sizes == 0).tolist()), n + ending(END))
        place = np.arange(n + ENDINGS)
        tail = np.concatenate([listed.endings() if tails is None else tails, np.arange(ENDINGS)]).astype(np.int64)
        self.told = min(modelled, n)
        self.modelled = place < self.told
        self.cls = np.where(self.modelled, place // CLASS, CLASSES + tail % CLASSES)
        # (nodes, slots) on the way to each word, by depth; the first classes are the first nodes
        head = place < min(CLASSES * CLASS, self.told)
        self.way = [(np.where(head, place // CLASS, -1), place % CLASS)]
        self.nodes, self.trees = CLASSES, 0
        deep, q = self.told - CLASSES * CLASS, place - CLASSES * CLASS
        if deep > 0:
            depth = 1
            while CLASSES * CLASS**depth < deep:
                depth += 1
            inside = self.modelled & (q >= 0)
            self.trees = -(-deep // CLASS**depth)
            self.cls = np.where(inside, 2 * CLASSES + q // CLASS**depth, self.cls)
            for d in range(depth, 0, -1):
                self.way.append((np.where(inside, self.nodes + q // CLASS**d, -1), q // CLASS ** (d - 1) % CLASS))
                self.nodes += -(-deep // CLASS**d)
        self.reserved = -(-self.nodes // BLOCK) * BLOCK if self.nodes > CLASS else CLASS
        self.count = np.concatenate([listed.counts, np.zeros(ENDINGS, np.int64)])
        history = np.where(place < min(named, n), place, named + tail).astype(np.uint64)
        self.history = (history + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
        self.history ^= self.history >> np.uint64(32)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Listed words by hash; the driver looks none up and so doesn't build it."""
        _, _, _, h, which = hashed(self.listed.data, self.listed.sizes, self.powers)  # the end token alone has no word
        return hash_table(h, which)

    def steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tokens take a step of the second softmax, at which nodes, and to which slots."""
        inner, k, slot = [], [], []
        for node, branch in self.way:
            at = node[x]
            i = np.flatnonzero(at >= 0)
            inner.append(i)
            k.append(at[i])
            slot.append(branch[x[i]])
        return np.concatenate(inner), np.concatenate(k), np.concatenate(slot)

    def positions(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        """Positions of all tokens, which of them end a text, and (text, word) of those that aren't listed."""
        data, starts, ends, h, which = tokens(texts, self.powers)
        at = find(*self.table, h)
        rest = []
        for i in np.flatnonzero(at < 0).tolist():
            word = data[starts[i] : ends[i]]
            at[i] = self.n + ending(word)
            rest.append((int(which[i]), word))
        sizes = np.bincount(which, minlength=len(texts)) + 1
        x = np.full(len(at) + len(texts), self.end)
        last = np.zeros(len(x), bool)
        last[np.cumsum(sizes) - 1] = True
        x[~last] = at
        return x, last, rest


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing: keys (odd) and values by slot; 0 marks a free slot."""
    size = 1 << max(4, int(4 * len(keys)).bit_length())
    slots, held = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
    mask = np.uint64(size - 1)
    todo, at = np.arange(len(keys)), (keys >> np.uint64(1)) & mask
    while len(todo):
        _, first = np.unique(at, return_index=True)
        mine = np.zeros(len(todo), bool)
        mine[first] = True
        mine &= slots[at] == 0
        slots[at[mine]], held[at[mine]] = keys[todo[mine]], values[todo[mine]]
        todo, at = todo[~mine], (at[~mine] + np.uint64(1)) & mask
    return slots, held


def find(slots: np.ndarray, held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Values of keys, -1 where unknown."""
    mask = np.uint64(len(slots) - 1)
    at = (keys >> np.uint64(1)) & mask
    seen = slots[at]
    out = np.where(seen == keys, held[at], -1)
    todo = np.flatnonzero((seen != keys) & (seen != 0))
    while len(todo):
        at[todo] = (at[todo] + np.uint64(1)) & mask
        seen = slots[at[todo]]
        hit = seen == keys[todo]
        out[todo[hit]] = held[at[todo[hit]]]
        todo = todo[~hit & (seen != 0)]
    return out


def start(listed: Counted | list[tuple[str, int]], mass: list[int], lexicon: Lexicon, buckets: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First weights (shares without a history) of both softmaxes, and what is added to bar classes and slots without words."""
    buckets = buckets or BUCKETS
    wide, more = 2 * CLASSES + lexicon.trees, lexicon.reserved if lexicon.nodes > CLASS else 0
    first, second = np.zeros((buckets, wide), np.float32), np.zeros((buckets + more, CLASS), np.float32)
    told = lexicon.count[: lexicon.told].astype(np.float64)
    every = sum(mass) + told.sum() + 1
    barred, empty = np.zeros(wide, np.float32), np.full((lexicon.nodes, CLASS), -1e9, np.float32)
    held = np.zeros((lexicon.nodes, CLASS))
    places = np.arange(lexicon.told)
    for node, slot in lexicon.way:
        i = places[node[places] >= 0]
        np.add.at(held, (node[i], slot[i]), told[i])
        empty[node[i], slot[i]] = 0
    used = empty == 0
    second[: lexicon.nodes][used] = np.log((held[used] + 1) / every)
    sums = np.bincount(lexicon.cls[places], told, wide)
    for k in range(wide):
        total = mass[k - CLASSES] if CLASSES <= k < 2 * CLASSES else sums[k]
        first[0, k] = np.log((total + 1) / every)
        barred[k] = -1e9 if k < CLASSES and k * CLASS >= len(listed) else 0
    return first, second, barred, empty


def histories(x: np.ndarray, ends: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Four feature hashes for each token; ``ends`` marks the last token of each document."""
    h = lexicon.history[x]
    since = _since(ends)
    back = []
    for k in (1, 2, 3):
        b = np.zeros(len(x), np.uint64)
        b[k:] = h[:-k] if len(x) > k else h[:0]
        b[since < k] = np.uint64(0)
        back.append(b)
    one, two, three = back
    mix = lambda a, salt: ((a ^ np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    return np.stack([mix(one, 11), mix(one * np.uint64(31) + two, 23), mix(two, 37), mix(three, 53)])


def _since(ends: np.ndarray) -> np.ndarray:
    """For each token, how many precede it in its document."""
    at = np.arange(len(ends))
    first = np.zeros(len(ends), np.int64)
    first[1:] = np.where(ends[:-1], at[1:], 0)
    return at - np.maximum.accumulate(first)


def softmax(z: np.ndarray) -> np.ndarray:
    """Shares; weights start at the logarithms of shares, so that no exponential overflows."""
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def gathered(weights: np.ndarray, z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``z`` with the rows of weights of each feature added in place."""
    room = np.empty_like(z)
    for a in at:
        weights.take(a, axis=0, out=room, mode="clip")  # all rows exist; other modes copy first
        z += room
    return z


def rest(f: np.ndarray, n: int) -> np.ndarray:
    """``f`` modulo ``n``; numpy divides by one number faster than it takes rests."""
    return (f - f // np.uint64(n) * np.uint64(n)).astype(np.int64)


def forward(x: np.ndarray, f: np.ndarray, model: tuple, lexicon: Lexicon, steps: tuple | None = None):
    """Class shares of all tokens; of each step within a class (``Lexicon.steps``) its token, node, features and slot shares."""
    first, second, barred, empty = model
    at = CLASS + rest(f, len(first) - CLASS)
    z = gathered(first, np.tile(first[0] + barred, (len(x), 1)), at)
    inner, k, _ = steps or lexicon.steps(x)
    at2 = lexicon.reserved + rest(f.take(inner, axis=1) * np.uint64(33) + k.astype(np.uint64) * np.uint64(0x9E3779B1), len(second) - lexicon.reserved)
    z2 = gathered(second, (second[: len(empty)] + empty).take(k, axis=0), at2)
    return at, softmax(z), inner, k, at2, softmax(z2)


FEW, LONG = 4, 32
CHUNK = 1024


def summed(g: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``g`` over runs of ``order``, of which the longest come first."""
    total = np.empty((len(first), g.shape[1]), g.dtype)
    runs, long = (int(x) for x in np.searchsorted(-n, [-FEW, -LONG]))  # runs above each length
    if runs:
        sizes = n[:runs]
        ends = np.cumsum(sizes)
        rows = g.take(order[np.repeat(first[:runs] - (ends - sizes), sizes) + np.arange(int(ends[-1]))], axis=0)
        for i in range(long):
            np.add.reduce(rows[ends[i] - n[i] : ends[i]], axis=0, out=total[i])
        if long < runs:
            total[long:runs] = np.add.reduceat(rows, (ends - sizes)[long:], axis=0)
    total[runs:] = g.take(order[first[runs:]], axis=0)
    for j in range(1, FEW):
        k = int(np.searchsorted(-n, -j))
        total[runs:k] += g.take(order[first[runs:k] + j], axis=0)
    return total


def scatter(weights: np.ndarray, square: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    """AdaGrad on rows of weights, from summed gradients of one batch."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort at this width
    if len(weights) > 1 << 16:
        order = order[np.argsort((rows >> 16).astype(np.uint16)[order], kind="stable")]
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    n = np.diff(first, append=len(rows))
    longest = np.argsort((-n).astype(np.int16) if len(rows) < 1 << 15 else -n, kind="stable")  # a radix sort, too
    first, n = first[longest], n[longest]
    total, at = summed(g, order, first, n), rows[first]
    whole = np.dtype((np.void, weights.strides[0]))  # a row as one item, which is written at once
    to_weights, to_square = weights.view(whole).ravel(), square.view(whole).ravel()
    room, held, new_held = (np.empty((min(CHUNK, len(at)), g.shape[1]), g.dtype) for _ in range(3))
    for i in range(0, len(at), CHUNK):  # pieces that stay in the processor's cache
        some, change = at[i : i + CHUNK], total[i : i + CHUNK]
        s = square.take(some, axis=0, out=held[: len(some)], mode="clip")
        s += np.multiply(change, change, out=room[: len(some)])
        np.put(to_square, some, s.view(whole).ravel())
        s += 1
        np.sqrt(s, out=s)
        change /= s
        change *= rate
        new = weights.take(some, axis=0, out=new_held[: len(some)], mode="clip")
        new -= change
        np.put(to_weights, some, new.view(whole).ravel())


def learn(docs: DataFrame, model: tuple, listed: Listed, rate: float, work: Workspace, name: str) -> None:
    """One round over ``docs`` (text): adds the averaged changes to the weights of ``model``, which learners have a copy of."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model, listed))

    def run(batches):
        import pyarrow as pa

        (first, second, barred, empty), listed = shared.value
        lexicon = listed.lexicon()
        own = [first.copy(), second.copy()]
        square = [np.zeros_like(first), np.zeros_like(second)]

        def step(x, ends):
            every = histories(x, ends, lexicon)
            for i in range(0, len(x), BATCH):
                part, f = x[i : i + BATCH], every[:, i : i + BATCH]
                steps = lexicon.steps(part)
                at, p, inner, k, at2, p2 = forward(part, f, (*own, barred, empty), lexicon, steps)
                p[np.arange(len(part)), lexicon.cls[part]] -= 1
                p2[np.arange(len(inner)), steps[2]] -= 1
                for a in at:
                    scatter(own[0], square[0], a, p, rate)
                scatter(own[0], square[0], np.zeros(1, np.int64), p.sum(axis=0, keepdims=True), rate)
                if len(inner):
                    for a in at2:
                        scatter(own[1], square[1], a, p2, rate)
                    head = int((k < CLASSES).sum())  # steps are listed by depth
                    bias = np.eye(CLASSES, dtype=np.float32)[k[:head]].T @ p2[:head]
                    scatter(own[1], square[1], np.arange(CLASSES), bias, rate)
                    if head < len(k):
                        scatter(own[1], square[1], k[head:], p2[head:], rate)

        for batch in batches:
            for texts in portions(batch.column(0)):
                step(*lexicon.positions(texts)[:2])
        rows: list[tuple] = []
        for which, (new, old) in enumerate(zip(own, (first, second))):
            change = (new - old).astype(np.float16).reshape(-1, BLOCK, new.shape[1])
            moved = (square[which].reshape(-1, BLOCK, new.shape[1]) > 0).any(axis=2)
            rows += [(which << 20 | b, change[b][moved[b]].tobytes(), np.flatnonzero(moved[b]).astype("<u2").tobytes()) for b in np.flatnonzero(moved.any(axis=1))]
        for i in range(0, len(rows), 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 16]), (pa.int32(), pa.binary(), pa.binary()))], ["block", "change", "rows"])

    def average(batches):
        import pyarrow as pa

        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, change, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = np.frombuffer(rows, "<u2")
                change = np.frombuffer(change, np.float16).reshape(len(rows), -1).astype(np.float64)
                total, times = held.setdefault(block, (np.zeros((BLOCK, change.shape[1])), np.zeros(BLOCK)))
                total[rows] += change
                times[rows] += 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([(t / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes() for t, n in held.values()], pa.binary())], ["block", "change"])

    parts = (len(model[0]) + len(model[1])) // BLOCK
    moved = docs.mapInArrow(run, "block int, change binary, rows binary").repartition(max(min(parts, 16), parts // 32), "block").mapInArrow(average, "block int, change binary")
    changes = work.table(moved, name)
    shared.destroy()
    for block, change in changes.toLocalIterator():  # as many rows as the model has blocks, a few files at a time
        which, b = block >> 20, block & (1 << 20) - 1
        width = model[which].shape[1]
        model[which][b * BLOCK : (b + 1) * BLOCK] += np.frombuffer(change, np.float32).reshape(-1, width)
    work.drop(name)


def score(docs: DataFrame, *, rate: float = 0.15) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "maxent")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), fold(F.col("doc_id")).alias("fold"))
    lexical = work.table(counts(own.filter("fold <> 2")), "counts")
    # how many words have at least a count, by eighths of a power of two: so many rows at most as counts have eighths
    eighth = F.floor(F.log2("c") * 8)
    steps = lexical.groupBy(eighth.alias("e")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.min("c").alias("least")).orderBy(F.desc("e")).collect()
    total, distinct = sum(r["n"] for r in steps), sum(r["v"] for r in steps)
    least, listed_n = None, 0
    for r in steps:
        if listed_n + r["v"] > FREQUENT:
            break
        least, listed_n = r["least"], listed_n + r["v"]
    listed = Counted.collected(lexical.filter(F.col("c") >= least)) if least is not None else Counted.of([])  # FREQUENT at most
    tail = F.pmod(F.pmod(F.crc32(F.expr("right(rtrim('.,', word), 3)")), F.lit(ENDINGS)), F.lit(CLASSES))
    sums = {r["k"]: (r["n"], r["v"]) for r in lexical.groupBy(tail.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    mass, kinds = [sums.get(k, (0, 0))[0] for k in range(CLASSES)], [sums.get(k, (0, 0))[1] for k in range(CLASSES)]
    modelled, named, buckets = sizes_for(total, int((listed.counts >= LEARNT).sum()))
    shelf = Listed(listed, modelled, named)
    for k, c in zip(shelf.parts[3][:modelled] % CLASSES, listed.counts[:modelled]):
        mass[k] -= int(c)
        kinds[k] -= 1
    model = start(listed, mass, Lexicon(*shelf.parts), buckets)
    learners = max(1, -(-total // LEARNER_TOKENS))
    for i, folds in enumerate(ROUNDS):
        shard = own.filter(F.col("fold").isin(*folds)).select("text").coalesce(int(learners))
        learn(shard, model, shelf, rate / (i + 1), work, f"round-{i}")
    shared = spark.sparkContext.broadcast((model, shelf, np.log10(np.array(mass, float) + np.array(kinds) + 1)))
    room = float(np.log10(total + distinct + 1))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        model, listed, shares = shared.value
        lexicon = listed.lexicon()
        shares = np.concatenate([np.zeros(CLASSES), shares, np.zeros(lexicon.trees)])
        logs = np.log10(lexicon.count + 1.0)
        row = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.string())

        def judged(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
            out = np.empty(len(x))
            every = histories(x, ends, lexicon)
            for i in range(0, len(x), BATCH):
                part = x[i : i + BATCH]
                steps = lexicon.steps(part)
                _, p, inner, _, _, p2 = forward(part, every[:, i : i + BATCH], model, lexicon, steps)
                k = lexicon.cls[part]
                s = np.log10(np.maximum(p[np.arange(len(part)), k], 1e-30)) - shares[k] + np.where(lexicon.modelled[part], 0, logs[part])
                s += np.bincount(inner, np.log10(np.maximum(p2[np.arange(len(inner)), steps[2]], 1e-30)), len(part))
                out[i : i + BATCH] = s
            return out

        for batch in batches:
            done = 0
            for texts in portions(batch.column(1)):
                some = batch.slice(done, len(texts))
                done += len(texts)
                x, ends, missing = lexicon.positions(texts)
                rest: list[list[bytes]] = [[] for _ in texts]
                for i, w in missing:
                    rest[i].append(w)
                sizes = np.diff(np.concatenate([[-1], np.flatnonzero(ends)]))
                first = np.cumsum(sizes) - sizes
                known = np.add.reduceat((lexicon.count[x] > 0).astype(np.int64), first)
                base = np.add.reduceat(logs[x] - room, first)
                mine = np.add.reduceat(judged(x, ends), first)
                rows = pa.array(range(row, row + len(texts)), pa.int64())
                row += len(texts)
                yield pa.RecordBatch.from_arrays([rows, some.column(0), some.column(2), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(mine), pa.array(rest, kind)], ["row", "doc_id", "fold", "n_tokens", "n_known", "base", "score", "rest"])

    schema = "row long, doc_id long, fold long, n_tokens long, n_known long, base double, score double, rest array<string>"
    seen = work.table(own.select("doc_id", "text", F.col("fold").cast("long")).mapInArrow(run, schema), "scored")
    shared.destroy()
    # counts of rarer words: every one adds the same to both scores
    rare = seen.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    few = lexical.filter(F.col("c") < least) if least is not None else lexical
    extra = rare.join(few, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("also"))
    more, also = F.coalesce("more", F.lit(0.0)), F.coalesce("also", F.lit(0).cast("long"))
    return seen.drop("rest").join(extra, "row", "left").select(
        "doc_id", (F.col("fold") == 2).alias("held_out"), "n_tokens", (F.col("n_known") + also).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those outside fold 2."""
    return score(load(spark, sf_dir, "documents"))
