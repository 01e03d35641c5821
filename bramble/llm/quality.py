"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model counts character n-grams of all trusted texts, for each language apart.  Its
counts, continuation counts, context totals and discounts are joined in Spark,
sharded by language and context, up to a table of log probabilities and
back-off weights.  Every Python worker reads it, one after the other of its parts of ``HELD`` rows if it is
larger, and every document is scored where it is read.
A language's limit is a quantile of the perplexity of all its trusted documents, each under a model
of the half of them that it isn't in; a document above the limit is rejected, one at the limit is kept.
With ``sample``, the model is one of a bounded sample and limits are those of the documents outside it.

A null or empty text is rejected, with null perplexity.  A document in a language
without trusted texts can't be judged: null perplexity and limit, kept.  A null
language is a language of its own.  A document is trusted if all its labels say
quality 1 and none says toxic; without labels nothing is judged.  Repeated rows
get equal results; other columns are ignored, whatever their names (``filtered`` keeps them).
"""

from __future__ import annotations

from functools import cache
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.dataset import dataset
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from bramble.llm.common import Workspace, fresh, load, open_fs, small_batches

ORDER = 5
#: Trusted documents of a language that a model of a sample is trained on at most, chosen by hash.
SAMPLE = 500
#: Languages that are judged, and trusted documents that the model is trained on, at most, if it is a sample's.
LANGUAGES, TRAINED = 64, 8000
QUANTILE = 0.99
BEGIN, END = "\x02", "\x03"
PRIME = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 19
#: Characters that are counted at once, and rows of a model that a worker holds at once (64 bytes each at most).
COUNTED, HELD = 1 << 20, 1 << 22
#: Characters that are scored at once by a model in parts.
SPREAD = 1 << 22
#: Trusted documents whose ids a worker holds at most; the texts of more are joined with them.
IDS = 1 << 23
_loaded: dict[str, Model] = {}
_parts: dict[str, Model] = {}
_ids: dict[str, np.ndarray] = {}


def count(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Grams of the highest order in padded texts, and how often they occur."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.ones(len(codes), bool)
    ends = np.cumsum([len(t) for t in texts])
    for j in range(1, ORDER):
        starts[ends - j] = False
    starts = np.flatnonzero(starts)
    low = np.zeros(0x110000, np.int64)
    low[codes] = 1
    kinds = int(low.sum())
    low[low > 0] = np.arange(kinds)
    low = low[codes]
    key, bound = low[starts], kinds
    for j in range(1, ORDER):
        if bound * kinds >= 1 << 63:
            some, key = np.unique(key, return_inverse=True)
            bound = len(some)
        key = key * kinds + low[starts + j]
        bound *= kinds
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    rows = codes[starts[first][:, None] + np.arange(ORDER)]
    sizes = (1 + (rows > 0x7F) + (rows > 0x7FF) + (rows > 0xFFFF)).sum(1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = rows.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(data)), times


def ids_at(place: str) -> np.ndarray:
    """The ids of a written table in order; a Python worker reads them once."""
    if place not in _ids:
        store, path = open_fs(place)
        _ids.clear()
        _ids[place] = np.sort(dataset(path, filesystem=store, format="parquet").to_table(columns=["doc_id"]).column(0).to_numpy())
    return _ids[place]


def only(batches, place: str | None):
    """Batches with the rows whose doc_id is in the table at ``place``; all of them without one."""
    for batch in batches:
        if place is not None:
            ids, own = ids_at(place), batch.column("doc_id")
            values = own.fill_null(0).to_numpy()
            at = np.searchsorted(ids, values)
            hit = (at < len(ids)) & own.is_valid().to_numpy(zero_copy_only=False)
            hit[hit] = ids[at[hit]] == values[hit]
            batch = batch.filter(pa.array(hit))
        if len(batch):
            yield batch


def among(docs: DataFrame, trusted: DataFrame, work: Workspace) -> tuple[DataFrame, str | None]:
    """What ``only`` takes for the rows of ``docs`` that are trusted: workers read up to ``IDS`` ids, so that texts aren't shuffled; more are joined."""
    if trusted.count() <= IDS:
        return docs, work.sub("trusted")
    return docs.join(trusted.select("doc_id"), "doc_id"), None


def grams(texts: DataFrame, ids: str | None = None) -> DataFrame:
    """(lang, gram, c): counts of the highest order in (lang, text); with a column ``half``, 0 or 1, also those of the halves, c0 and c1.

    With a table of ``ids``, counts are those of the rows whose doc_id it has.
    """
    halves = "half" in texts.columns
    texts = texts.select("lang", "text", F.col("half").cast("int") if halves else F.lit(0).alias("half"), *(() if ids is None else ("doc_id",)))

    def flush(held):
        for (lang, half), some in held.items():
            found, times = count(some)
            none = np.zeros(len(times), np.int64)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(times)), found, *(pa.array(times if half == i else none) for i in (0, 1))], ["lang", "gram", "c0", "c1"])

    def run(batches):
        held, n = {}, 0
        for batch in only(batches, ids):
            for lang, text, half in zip(*(batch.column(i) for i in range(3))):
                t = BEGIN * (ORDER - 1) + text.as_py() + END
                for a in range(0, len(t) - ORDER + 1, COUNTED):  # a very long text is taken in overlapping slices
                    held.setdefault((lang.as_py(), half.as_py()), []).append(t[a : a + COUNTED + ORDER - 1])
                    n += len(held[lang.as_py(), half.as_py()][-1])
                    if n >= COUNTED:
                        yield from flush(held)
                        held, n = {}, 0
        yield from flush(held)

    found = texts.mapInArrow(run, "lang string, gram string, c0 long, c1 long").groupBy("lang", "gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    return found.select("lang", "gram", (F.col("c0") + F.col("c1")).alias("c"), *(("c0", "c1") if halves else ()))


def kneser_ney(counted: DataFrame, work: Workspace, kinds: tuple[str, ...] = ("",)) -> DataFrame:
    """(lang, gram, p, back) from counts of the highest order: interpolated probability, and the weight of the gram as a context.

    ``kinds`` are endings of the columns: c, p and back of several models, which are worked out side by side.
    p(gram) = alpha(gram) + back(context) * p(gram without its first character), an order after the other.
    What only begins texts is a context and no gram: its p is null.  Where a model doesn't know a gram, both are null.
    """
    col = lambda name, v: F.col(f"{name}{v}")
    per = lambda *what: [f(v).alias(f"{name}{v}") for v in kinds for name, f in what]
    top = work.table(counted.select("lang", "gram", *(f"c{v}" for v in kinds)), "counts")
    # continuation counts: how many characters come before a gram
    ends = top.select("lang", F.explode(F.expr(f"transform(sequence(1, {ORDER - 1}), i -> substring(gram, i))")).alias("g"), *per(("c", lambda v: (col("c", v) > 0).cast("long"))))
    ends = ends.groupBy("lang", "g").agg(*per(("c", lambda v: F.max(col("c", v)))))
    below = ends.groupBy("lang", F.expr("substring(g, 2)").alias("gram")).agg(*per(("c", lambda v: F.sum(col("c", v)))))
    own = work.table(top.union(below).withColumn("k", F.length("gram")).withColumn("context", F.expr("substring(gram, 1, k - 1)")), "grams")
    times = lambda n, v: F.count(F.when(col("c", v) == n, 1))
    # small samples can give discounts out of range
    held = lambda x, most: F.least(F.greatest(x, F.lit(0.1)), F.lit(most))

    def discount(i, v):
        n = [F.greatest(times(j, v), F.lit(1)) for j in (1, 2, 3, 4)]
        return held(i - (i + 1) * n[0] / (n[0] + 2 * n[1]) * n[i] / n[i - 1], i - 0.1)

    known = lambda v: F.count(F.when(col("c", v) > 0, 1))
    discounts = own.groupBy("lang", "k").agg(*per(*((f"d{i}_", lambda v, i=i: discount(i, v)) for i in (1, 2, 3)), ("grams", known)))
    discounts = work.table(discounts, "discounts")
    totals = own.groupBy("lang", "k", "context").agg(*per(("total", lambda v: F.sum(col("c", v))), ("m1_", lambda v: times(1, v)), ("m2_", lambda v: times(2, v)), ("m3_", lambda v: F.count(F.when(col("c", v) >= 3, 1)))))
    back = lambda v: F.when(col("total", v) > 0, sum(col(f"d{i}_", v) * col(f"m{i}_", v) for i in (1, 2, 3)) / col("total", v))
    totals = totals.join(discounts, ["lang", "k"]).select("lang", "k", "context", *(f"{x}{v}" for v in kinds for x in ("total", "d1_", "d2_", "d3_")), *per(("back", back)))
    totals = work.table(totals, "contexts")
    less = lambda v: F.when(col("c", v) == 1, col("d1_", v)).when(col("c", v) == 2, col("d2_", v)).otherwise(col("d3_", v))
    alpha = lambda v: F.when(col("c", v) > 0, (col("c", v) - less(v)) / col("total", v))
    added = work.table(own.join(totals, ["lang", "k", "context"]).select("lang", "gram", "k", *per(("alpha", alpha), ("back", lambda v: col("back", v)))), "added")
    kind = discounts.filter("k = 1").select("lang", *per(("p", lambda v: 1 / (col("grams", v) + 1))))
    p, done = None, []
    for k in range(1, ORDER + 1):
        before = kind if p is None else p.withColumnRenamed("gram", "end")
        grown = added.filter(F.col("k") == k).withColumn("end", F.expr("substring(gram, 2)")).join(before, ["lang"] if p is None else ["lang", "end"])
        p = work.table(grown.select("lang", "gram", *per(("p", lambda v: col("alpha", v) + col("back", v) * col("p", v)))), f"order{k}")
        done.append(p)
    for x in done[:-1]:
        p = p.union(x)
    out = p.join(totals.filter("k > 1").select("lang", F.col("context").alias("gram"), *(f"back{v}" for v in kinds)), ["lang", "gram"], "full")
    # what an unknown character gets, under the empty gram
    none = totals.filter("k = 1").join(kind, "lang").select("lang", F.lit("").alias("gram"), *per(("p", lambda v: col("back", v) * col("p", v)), ("back", lambda v: F.lit(None).cast("double"))))
    return work.table(out.unionByName(none), "model")


def in_parts(model: DataFrame, place: str, work: Workspace, name: str) -> list[str]:
    """Places of a model's parts, of about ``HELD`` rows at most; the model's own place if that is enough."""
    parts = -(-model.count() // HELD)
    if parts <= 1:
        return [place]
    for i in range(parts):
        work.table(model.filter(F.pmod(F.xxhash64("lang", "gram"), F.lit(parts)) == i), f"{name}{i}")
    return [work.sub(f"{name}{i}") for i in range(parts)]


class Model:
    """The table as open-addressed arrays: log10 probability and back-off of a gram by its hash."""

    def __init__(self, table):
        """``table``: an Arrow table (lang, gram, p, back), or batches of one."""
        self.langs: dict[str, int] = {}
        keys, p, back, unknown = [], [], [], {}
        for batch in table.to_batches() if isinstance(table, pa.Table) else table:
            lang, texts = batch.column("lang").dictionary_encode(), batch.column("gram")
            seeds = np.array([self.langs.setdefault(x, len(self.langs) + 1) for x in lang.dictionary.to_pylist()], np.uint64)[lang.indices.to_numpy()] if len(lang) else np.zeros(0, np.uint64)
            shares, backs = (np.log10(batch.column(c).fill_null(x).to_numpy(zero_copy_only=False)).astype(np.float32) for c, x in (("p", np.nan), ("back", 1.0)))
            lengths = pc.utf8_length(texts).to_numpy()
            unknown |= zip(seeds[lengths == 0].tolist(), np.log10(batch.column("p").filter(pa.array(lengths == 0)).to_numpy()))
            for k in range(1, ORDER + 1):
                at = np.flatnonzero(lengths == k)
                if len(at):
                    text = texts.take(pa.array(at)).buffers()[2].to_pybytes().decode()
                    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, k)
                    h = np.zeros(len(at), np.uint64)
                    for j in range(k):
                        h = h * PRIME + codes[:, j] + np.uint64(1)
                    keys.append(self.final(h, k, seeds[at]))
                    p.append(shares[at])
                    back.append(backs[at])
        self.unknown = np.zeros(len(self.langs) + 1)
        self.unknown[list(unknown)] = list(unknown.values())
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (keys, p, back)]
        size = 1 << max(4, int(2 * len(flat[0])).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.p, self.back = np.zeros(size, np.uint64), np.zeros(size, np.float32), np.zeros(size, np.float32)
        todo, at = np.arange(len(flat[0])), flat[0].astype(np.uint64) & self.mask
        while len(todo):
            free = self.keys[at] == 0
            _, first = np.unique(at, return_index=True)
            mine = np.zeros(len(todo), bool)
            mine[first] = True
            mine &= free
            for to, values in ((self.keys, flat[0]), (self.p, flat[1]), (self.back, flat[2])):
                to[at[mine]] = values[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + np.uint64(1)) & self.mask

    @classmethod
    def at(cls, place: str, part: bool = False) -> Model:
        """The model written at ``place``; a Python worker reads it once, so that it never passes through the driver.

        A worker holds one at a time; the arrays of a part are kept in a file without name.
        """
        if place not in _loaded:
            for old in _loaded.values():
                old.leave()
            _loaded.clear()
            if place in _parts:
                _loaded[place] = _parts[place].back_again()
                return _loaded[place]
            store, path = open_fs(place)
            _loaded[place] = cls(dataset(path, filesystem=store, format="parquet").to_batches(columns=["lang", "gram", "p", "back"], batch_readahead=1, fragment_readahead=1))
            pa.default_memory_pool().release_unused()
            if part:
                for old in [x for x in _parts if x.rpartition("/")[0] != place.rpartition("/")[0]]:
                    del _parts[old]
                _parts[place] = _loaded[place].keep()
        return _loaded[place]

    @staticmethod
    def final(h: np.ndarray, k: int, seed: np.ndarray) -> np.ndarray:
        h = (h ^ (seed * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k))) * PRIME
        return (h ^ (h >> np.uint64(32))) | np.uint64(1 << 63)  # 0 marks a free slot

    def keep(self) -> Model:
        self.file = TemporaryFile()
        for x in (self.keys, self.p, self.back):
            self.file.write(x.data)
        return self

    def leave(self) -> None:
        self.keys = self.p = self.back = None

    def back_again(self) -> Model:
        self.file.seek(0)
        n = int(self.mask) + 1
        self.keys, self.p, self.back = (np.frombuffer(self.file.read(n * np.dtype(t).itemsize), t) for t in (np.uint64, np.float32, np.float32))
        return self

    @staticmethod
    def hashes(codes: np.ndarray) -> list[np.ndarray]:
        """For each order, the hash of the gram that ends at each position."""
        codes = codes.astype(np.uint64) + np.uint64(1)
        out = []
        power, h = np.uint64(1), np.zeros(len(codes), np.uint64)
        for k in range(1, ORDER + 1):
            h = h.copy()
            h[k - 1 :] += codes[: len(codes) - k + 1] * power
            with np.errstate(over="ignore"):
                power = power * PRIME
            out.append(h)
        return out

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where unknown."""
        at = keys & self.mask
        out = np.full(len(keys), -1, np.int64)
        seen = self.keys[at]
        hit = seen == keys
        out[hit] = at[hit]
        todo = np.flatnonzero(~hit & (seen != 0))
        while len(todo):
            a = (at[todo] + np.uint64(1)) & self.mask
            at[todo] = a
            seen = self.keys[a]
            hit = seen == keys[todo]
            out[todo[hit]] = a[hit]
            todo = todo[~hit & (seen != 0)]
        return out

    def logs(self, codes: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """log10 probability of each character but the first ORDER - 1, which are context."""
        n = len(codes) - ORDER + 1
        hashes = self.hashes(codes)
        rest = np.arange(ORDER - 1, len(codes))
        out = np.zeros(len(codes))
        for k in range(ORDER, 0, -1):
            at = self.places(self.final(hashes[k - 1][rest], k, seed[rest]))
            hit = (at >= 0) & ~np.isnan(self.p[at])
            out[rest[hit]] += self.p[at[hit]]
            rest = rest[~hit]
            if k > 1 and len(rest):
                at = self.places(self.final(hashes[k - 2][rest - 1], k - 1, seed[rest]))
                hit = at >= 0
                out[rest[hit]] += self.back[at[hit]]
        out[rest] += self.unknown[seed[rest].astype(np.int64)]
        return out[-n:]

    def perplexities(self, langs: list[str], texts: list[str]) -> list[float | None]:
        def logs(codes, names, which):
            return self.logs(codes, np.array([self.langs.get(x, 0) for x in names], np.uint64)[which])

        return perplexities(logs, [x if x in self.langs else None for x in langs], texts, SLICE)


@cache
def judged(places: tuple[str, ...]) -> frozenset[str]:
    """Languages of a model in parts."""
    stores = [open_fs(x) for x in places]
    return frozenset(x for store, path in stores for x in pc.unique(dataset(path, filesystem=store, format="parquet").to_table(columns=["lang"]).column(0)).to_pylist())


def perplexities(logs, langs: list[str | None], texts: list[str | None], most: int) -> list[float | None]:
    """Perplexities of texts by ``logs``, which gets ``most`` characters or a text's end at once; none without language or text."""
    out: list[float | None] = [None] * len(texts)
    held: list[int] = []
    n = 0
    for i, (lang, text) in enumerate(zip(langs, texts)):
        if text and lang is not None:
            held.append(i)
            n += len(text) + ORDER
        if held and (n >= most or i == len(texts) - 1):
            _some(logs, held, langs, texts, out, most)
            held, n = [], 0
    return out


def _some(logs, held: list[int], langs, texts, out, most: int) -> None:
    codes = np.frombuffer("".join(BEGIN * (ORDER - 1) + texts[i] + END for i in held).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(texts[i]) + ORDER for i in held])
    ends = np.cumsum(sizes)
    names = list(dict.fromkeys(langs[i] for i in held))
    which = np.repeat(np.array([names.index(langs[i]) for i in held]), sizes)
    found = np.zeros(len(codes))
    for a in range(ORDER - 1, len(codes), most):  # a very long text is taken in overlapping slices
        b = min(len(codes), a + most)
        found[a:b] = logs(codes[a - ORDER + 1 : b], names, which[a - ORDER + 1 : b])
    for first in ends - sizes:
        found[first : first + ORDER - 1] = 0
    for i, total, size in zip(held, np.add.reduceat(found, ends - sizes), sizes):
        out[i] = float(10 ** (-total / (size - ORDER + 1)))


def logs_in_parts(places: list[str], codes: np.ndarray, names: list[str], which: np.ndarray) -> np.ndarray:
    """``Model.logs`` where the model is in parts: one after the other is read, and is asked for every order of all characters."""
    p, back, unknown = np.full((ORDER, len(codes)), np.nan, np.float32), np.zeros((ORDER, len(codes)), np.float32), np.zeros(len(codes))
    for place in places:
        part = Model.at(place, True)
        seeds = np.array([part.langs.get(x, 0) for x in names], np.uint64)[which]
        unknown += part.unknown[seeds.astype(np.int64)]
        for a in range(0, len(codes), SLICE):
            before = min(a, ORDER - 1)
            hashes = [h[before:] for h in Model.hashes(codes[a - before : a + SLICE])]
            for k in range(1, ORDER + 1):
                at = part.places(part.final(hashes[k - 1], k, seeds[a : a + SLICE]))
                hit = np.flatnonzero(at >= 0)
                p[k - 1, a + hit], back[k - 1, a + hit] = part.p[at[hit]], part.back[at[hit]]
    rest = np.arange(ORDER - 1, len(codes))
    out = np.zeros(len(codes))
    for k in range(ORDER, 0, -1):
        hit = ~np.isnan(p[k - 1, rest])
        out[rest[hit]] += p[k - 1, rest[hit]]
        rest = rest[~hit]
        if k > 1:
            out[rest] += back[k - 2, rest - 1]
    out[rest] += unknown[rest]
    return out[ORDER - 1 :]


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))


def half() -> Column:
    """Which half of the trusted documents one is in; equal texts are in the same."""
    return F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(2))


def trained(docs: DataFrame, labels: DataFrame, work: Workspace, sample: int | None = None) -> tuple[list[str], DataFrame]:
    """Where the model's parts are written, and (doc_id, seen) of all trusted documents.

    All of them are seen in training, and two models of a half each are written beside the model.  With ``sample``, at most so many and
    half of a language's are seen, in the ``LANGUAGES`` with most of them, ``TRAINED`` in all.
    """
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    # written out, so that its size decides how it is joined
    trusted = work.table(told.filter("q = 1 and coalesce(t, 0) = 0 and doc_id is not null").select("doc_id"), "trusted")
    own = texts_of(docs)
    if sample is None:
        texts, ids = among(own.filter("text <> ''"), trusted, work)
        model = kneser_ney(grams(texts.withColumn("half", half()), ids), work, ("", "0", "1"))
        return in_parts(model.select("lang", "gram", "p", "back"), work.sub("model"), work, "part"), trusted.withColumn("seen", F.lit(True))
    ids = own.select("doc_id", "lang").join(trusted, "doc_id").distinct()
    many = work.table(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES), "languages")
    sample = max(1, min(sample, TRAINED // max(1, many.count())))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    # first by a share of the hashes, so that ranking reads a bounded number of rows
    near = ids.join(many, "lang").withColumn("draw", draw).filter(F.col("draw") * F.col("n") < 2 * sample + 100)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    most = F.greatest(F.lit(1), F.least(F.lit(sample), F.floor(F.col("n") / 2)))
    # TRAINED rows at most, so it may be broadcast
    chosen = work.table(near.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "lang"), "sample")
    told = trusted.join(chosen.select("doc_id", F.lit(True).alias("seen")).distinct(), "doc_id", "left").select("doc_id", F.coalesce("seen", F.lit(False)).alias("seen"))
    texts = own.join(F.broadcast(chosen), ["doc_id", "lang"]).filter("text <> ''").select("lang", "text")
    kneser_ney(grams(texts), work)
    return [work.sub("model")], told


def scored(docs: DataFrame, places: list[str], name: str, key: Column | None = None, ids: str | None = None) -> DataFrame:
    """``docs`` with their perplexity in a column ``name``, and then the language's own name, null as "" (or another ``key`` of the model), in ``name`` + "_lang".

    With a table of ``ids``, only the rows whose doc_id it has.
    """
    own = docs.withColumn(f"{name}_lang", F.coalesce(F.col("lang").cast("string"), F.lit("")) if key is None else key)
    schema = T.StructType([*own.schema, T.StructField(name, T.DoubleType())])
    columns = list(own.columns)
    at = {c: i for i, c in enumerate(columns)}

    def fill(held):
        langs, texts = ([x for batch in held for x in batch.column(at[c]).to_pylist()] for c in (f"{name}_lang", "text"))
        if len(places) == 1:
            found = Model.at(places[0]).perplexities(langs, texts)
        else:
            known = judged(tuple(places))
            found = perplexities(lambda *args: logs_in_parts(places, *args), [x if x in known else None for x in langs], texts, SPREAD)
        n = 0
        for batch in held:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[n : n + len(batch)], pa.float64())], [*columns, name])
            n += len(batch)

    def run(batches):
        held, n = [], 0
        for batch in only(batches, ids):
            held.append(batch)
            n += batch.nbytes
            # parts of a model are read for as many texts at once as may be held
            if len(places) == 1 or n >= SPREAD:
                yield from fill(held)
                held, n = [], 0
        yield from fill(held)

    return own.mapInArrow(run, schema)


def limits(docs: DataFrame, trusted: DataFrame, places: list[str], work: Workspace, sample: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """(lang, limit): a row for each language that is judged, the quantile of all trusted documents not seen by the model that scores them.

    The model of the other half scores each document; with ``sample``, the model itself those outside the sample.
    Where this leaves a language without any, its limit is the quantile of all its trusted documents by the model.
    """
    own = texts_of(docs).filter("text <> ''")
    own, ids = among(own, trusted, work) if sample is None else (own.join(trusted, "doc_id"), None)
    # a hair above the quantile, as logarithms are taken and undone
    limit = (F.exp(F.percentile_approx(F.log("perplexity"), quantile, 10000)) * (1 + 1e-12)).alias("limit")
    if sample is None:
        model = work.spark.read.parquet(work.sub("model"))
        parts = [model.select(F.concat(F.lit(v), "lang").alias("lang"), "gram", F.col(f"p{v}").alias("p"), F.col(f"back{v}").alias("back")).filter("p is not null or back is not null") for v in "01"]
        halves = in_parts(work.table(parts[0].union(parts[1]), "halves"), work.sub("halves"), work, "half")
        new = scored(own.withColumn("other", F.concat((1 - half()).cast("string"), "lang")), halves, "perplexity", F.col("other"), ids)
    else:
        new = scored(own.filter("not seen"), places, "perplexity")
    # written out, so that its size decides how it is joined
    found = work.table(new.groupBy("lang").agg(limit), "limits")
    some = found.filter("limit is not null")
    if sample is None and found.filter("limit is null").isEmpty():
        return some
    rest = scored(own.join(some, "lang", "left_anti"), places, "perplexity", ids=ids).groupBy("lang").agg(limit).filter("limit is not null")
    return work.table(some.union(rest), "all_limits")


def accepted(filled: Column, perplexity: Column, limit: Column) -> Column:
    return filled & F.coalesce(perplexity <= limit, F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, *, sample: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, limit, kept) of every row of ``docs`` (doc_id, text, lang)."""
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "quality")
    places, trusted = trained(docs, labels, work, sample)
    bounds = limits(docs, trusted, places, work, sample, quantile)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
    filled = F.coalesce(F.length("text") > 0, F.lit(False)).alias("filled")
    thin = work.table(scored(own, places, "perplexity").select("doc_id", F.col("perplexity_lang").alias("lang"), "perplexity", filled), "scores")
    return thin.join(bounds, "lang", "left").select("doc_id", "lang", "perplexity", "limit", accepted(F.col("filled"), F.col("perplexity"), F.col("limit")).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, *, sample: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; they are scored as they are read."""
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "quality")
    places, trusted = trained(docs, labels, work, sample)
    name, lang, limit = fresh(docs, "perplexity", "judged_lang", "judged_limit")
    while any(c.lower() == f"{name}_lang" for c in docs.columns):
        name = "_" + name
    seen = scored(docs.withColumn("text", F.col("text").cast("string")), places, name)
    bounds = limits(docs, trusted, places, work, sample, quantile).select(F.col("lang").alias(lang), F.col("limit").alias(limit))
    filled = F.coalesce(F.length("text") > 0, F.lit(False))
    return seen.join(bounds, seen[f"{name}_lang"] == bounds[lang], "left").filter(accepted(filled, F.col(name), F.col(limit))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged by a model of trusted ones."""
    return judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
