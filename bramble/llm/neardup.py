"""Near-duplicate detection: MinHash bands, Bayesian pruning, exact verification.

A document's set is its distinct word shingles.  Documents of equal sets form a
class, and classes are compared once:

1. bands of a class's signature put it into buckets;
2. the least class of a bucket, its pivot, is paired with the others, which
   connects most buckets;
3. buckets that still hold classes not connected with each other are compared whole, in
   tiles of bounded size: those outside the bucket's largest component against
   all.  Tiles hold signatures, and give a pair only where it first meets;
4. a pair's signatures are compared batch by batch; it is dropped as soon as the
   posterior probability of the sought similarity falls below ``miss``;
5. survivors are verified on their full sets, and links are joined to components.

So each pair that shares a bucket is decided or already connected, without all pairs of
a bucket being made.  The hashes for bands and for comparison are independent.

Null and empty texts, and texts without words, have empty sets: linked with
nothing, their component is their own id.  Repeated rows have equal sets; rows with one
id and different texts are documents of their own.  A
null doc_id takes part in links but is never a component's id; without any
other id the component is null, and ``kept`` is false.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from math import lgamma, log

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import Workspace, fresh, load, small_batches
from bramble.llm.components import stars

BANDS, ROWS = 32, 5
#: Hashes for comparison, of which 8 bits are kept, and how many are looked at before a pair is judged again.
COMPARED, BATCH = 512, 32
#: Classes on a side of a tile, as an expectation.
TILE = 2048
#: Words whose hashes a task holds.
KNOWN = 1 << 16
SEED = 20240229
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of all its words if they are fewer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    for i in range(min(k, len(w))):
        h = (h ^ w[i : i + n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least 32-bit value of the set under each of the hash functions a*x+b."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 128):
        y = np.multiply.outer(x[i : i + 128], a)
        y += b
        np.minimum(low, y.min(axis=0), out=low)
    return low


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(SEED))
    return r.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, np.uint32)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the band's number is mixed in."""
    s = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ s[:, i]) * MULTIPLIER
        key ^= key >> np.uint64(31)
    return key


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches of n hashes at which P(similarity >= threshold) is at least ``miss``, from a uniform prior.

    The posterior is a Beta distribution, whose tail is P(Binomial(n + 1, threshold) <= matches).
    Of two unequal minima one in 256 agrees in the 8 bits kept.
    """
    threshold += (1 - threshold) / 256
    total = 0.0
    for m in range(n + 1):
        total += np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
        if total >= miss:
            return m
    return n


def classes(docs: DataFrame, k: int) -> DataFrame:
    """(row, doc_id, text_hash, n, digest, bands, signature) of each document; the last three are null for empty sets."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row, known = TaskContext.get().partitionId() << 40, WordHashes()
        a, b = functions(BANDS * ROWS + COMPARED)
        for batch in batches:
            out = []
            for text in batch.column(2):
                s = shingles(text.as_py(), k, known)
                if len(s):
                    low = signature(s, a, b)
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(low[: BANDS * ROWS]).tobytes(), low[BANDS * ROWS :].astype(np.uint8).tobytes()))
                else:
                    out.append((0, None, None, None))
            rows = pa.array(range(row, row + len(out)), pa.int64())
            row += len(out)
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(1), *columns], ["row", "doc_id", "text_hash", "n", "digest", "bands", "signature"])

    return hashed(docs).mapInArrow(run, "row long, doc_id long, text_hash long, n long, digest binary, bands binary, signature binary")


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): id and hash tell rows apart that share an id, or have none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))


def buckets(sets: DataFrame) -> DataFrame:
    """(key, id): a row for each band of each class."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                key = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "id"])

    return sets.select("id", "bands").mapInArrow(run, "key long, id long")


def pruned(pairs: DataFrame, sets: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) that the signatures don't rule out."""
    sides = [sets.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb")

    def run(batches):
        import pyarrow as pa

        steps = [(n, least_matches(n, threshold, miss)) for n in range(BATCH, COMPARED + 1, BATCH)]
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COMPARED) for i in (2, 3))
            yield batch.select([0, 1]).take(pa.array(alike(left, right, np.arange(batch.num_rows), np.arange(batch.num_rows), steps)))

    return both.mapInArrow(run, "a long, b long")


def alike(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs left[i], right[j] remain."""
    alive, got = np.arange(len(i)), np.zeros(len(i), np.int64)
    for n, least in steps:
        got = got + (left[i[alive], n - BATCH : n] == right[j[alive], n - BATCH : n]).sum(axis=1)
        alive, got = alive[got >= least], got[got >= least]
    return alive


def tiles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, x, y, side, id, n, label, home, bands, signature) of buckets ``members`` (key, id, label) that hold several labels.

    Side 0 are the classes outside the bucket's commonest label, side 1 are all; tile (x, y) has
    a share of each.  Both are dealt to as many tiles as the other side has shares.
    """
    sums = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("labels"))
    shares = lambda n: F.ceil(n / TILE).cast("int")
    plan = sums.filter("labels > 1").select("key", F.col("top.label").alias("home"), shares(F.col("m") - F.col("top.m")).alias("h"), shares(F.col("m")).alias("g"))
    own = members.join(plan, "key").withColumn("draw", F.xxhash64("id"))
    x, y = F.pmod("draw", F.col("h")).cast("int"), F.pmod("draw", F.col("g")).cast("int")
    away = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda v: F.struct(x.alias("x"), v.alias("y"), F.lit(0).alias("side")))
    every = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda v: F.struct(v.alias("x"), y.alias("y"), F.lit(1).alias("side")))
    dealt = own.select("key", "id", "label", "home", F.explode(F.when(F.col("label") != F.col("home"), F.concat(away, every)).otherwise(every)).alias("t")).select("key", "t.*", "id", "label", "home")
    return dealt.join(sets.select("id", "n", "bands", "signature"), "id")


def met(dealt: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) of different labels within tiles that their signatures don't rule out, each where it first meets."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "side").select("key", "x", "y", "side", "id", "n", "label", "home", "bands", "signature")

    def run(batches):
        import pyarrow as pa

        steps = [(k, least_matches(k, percent / 100, miss)) for k in range(BATCH, COMPARED + 1, BATCH)]

        def compare(rows: list):
            side, ids, sizes, labels, home = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5, 6, 7))
            bands = np.frombuffer(b"".join(r[8] for r in rows), np.uint64).reshape(-1, BANDS)
            seen = np.frombuffer(b"".join(r[9] for r in rows), np.uint8).reshape(-1, COMPARED)
            away, every = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            here = np.flatnonzero(bands[0] == np.int64(rows[0][0]).astype(np.uint64))[0]
            for at in range(0, len(away), 128):
                a = away[at : at + 128]
                p = 100 * np.minimum.outer(sizes[a], sizes[every]) >= percent * np.maximum.outer(sizes[a], sizes[every])
                p &= labels[a][:, None] != labels[every][None, :]
                # two classes that are both away meet twice
                p &= (labels[every] == home[every])[None, :] | (ids[a][:, None] < ids[every][None, :])
                i, j = np.nonzero(p)
                i, j = a[i], every[j]
                left = alike(seen, seen, i, j, steps)
                i, j = i[left], j[left]
                first = ~(bands[i, :here] == bands[j, :here]).any(axis=1)
                yield np.minimum(ids[i], ids[j])[first], np.maximum(ids[i], ids[j])[first]

        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    if len(held) > 1:
                        for a, b in compare(held):
                            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    held = []
                held.append(row)
        if len(held) > 1:
            for a, b in compare(held):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return sorted_.mapInArrow(run, "a long, b long")


def full_sets(needed: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, hashes) of the classes ``needed`` (id, doc_id, text_hash, digest), from their documents' texts."""
    texts = hashed(docs)
    met = texts.join(needed, texts["doc_id"].eqNullSafe(needed["doc_id"]) & (texts["text_hash"] == needed["text_hash"])).select("id", "digest", "text")

    def run(batches):
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            ids, sets = [], []
            for i, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingles(text.as_py(), k, known)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:  # not another text of that hash
                    ids.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "hashes"])

    return met.mapInArrow(run, "id long, hashes binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets (id, hashes)."""
    sides = [sets.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ha", "hb")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, *, shingle_words: int, percent: int, miss: float) -> DataFrame:
    """(doc_id, text_hash, n_shingles, label, component_id) of every row of ``docs`` (doc_id, text); a label names a component, and is null for empty sets."""
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    rows = work.table(classes(docs, shingle_words), "rows")
    # One row a class.  The least row stands for it; min is a partial aggregate, so copies of one text don't meet in a task.
    named = rows.filter("n > 0").groupBy("digest").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc"))
    sets = work.table(named.join(rows.select(F.col("row").alias("id"), "n", "bands", "signature", F.col("doc_id").alias("own"), "text_hash"), "id"), "sets")
    every = buckets(sets)
    pivots = every.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    members = work.table(every.join(pivots, "key"), "members")

    def decide(alive: DataFrame, name: str) -> DataFrame:
        alive = work.table(alive, f"alive-{name}")
        ids = alive.select(F.col("a").alias("id")).union(alive.select(F.col("b").alias("id"))).distinct()
        needed = sets.join(ids, "id").select("id", F.col("own").alias("doc_id"), "text_hash", "digest")
        full = work.table(full_sets(needed, docs, shingle_words), f"full-{name}")
        links = work.table(verified(alive, full, percent), f"verified-{name}")
        work.drop(f"alive-{name}")
        work.drop(f"full-{name}")
        return links

    pairs = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = stars(decide(pruned(pairs, sets, percent / 100, miss), "pivots"), work, "links-pivots")
    labelled = members.select("key", "id").join(links.select(F.col("hi").alias("id"), "lo"), "id", "left").select("key", "id", F.coalesce("lo", "id").alias("label"))
    more = decide(met(tiles(labelled, sets), percent, miss), "tiles")
    work.drop("members")
    links = stars(more.union(links.select(F.col("hi").alias("a"), F.col("lo").alias("b"))), work, "links")
    labelled = sets.join(links.select(F.col("hi").alias("id"), "lo"), "id", "left").select("digest", "doc", F.coalesce("lo", "id").alias("label"))
    least = labelled.groupBy("label").agg(F.min("doc").alias("least"))
    named = labelled.join(least, "label").select("digest", "label", "least")
    out = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "label", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    found = components(docs, shingle_words=shingle_words, percent=percent, miss=miss)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """One row of ``docs`` for each component, with all columns; a row without doc_id stays, as nothing names it.

    It is the row of the least id; of several with that id, the one of the least text hash.  Rows without words
    are one for each id and text.
    """
    found = components(docs, shingle_words=shingle_words, percent=percent, miss=miss).filter("doc_id = component_id")
    some = found.filter("n_shingles > 0").groupBy("label", "doc_id").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash")
    kept = some.union(found.filter("n_shingles = 0").select("doc_id", "text_hash")).distinct()
    i, h, a, b = fresh(docs, "id", "text_hash", "kept_id", "kept_hash")
    named = docs.withColumn(i, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64(F.col("text").cast("string")))
    one = named.join(kept.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)), (F.col(i) == F.col(a)) & (F.col(h) == F.col(b)), "left_semi")
    return one.dropDuplicates([i, h]).select(*docs.columns).union(named.filter(F.col(i).isNull()).select(*docs.columns))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at a similarity of 0.8 over 4-word shingles."""
    return near_duplicates(load(spark, sf_dir, "documents"), shingle_words=4)
