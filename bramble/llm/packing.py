"""Cost-balanced packing of tokenised documents into sequences.

A sequence costs ``linear * tokens + quadratic * sum(piece ** 2)``: attention is
computed within each piece.  Every task packs what it reads, in buffers of a
bounded number of tokens, so nothing is shuffled.  In a buffer, pieces go in
descending length to the sequence of least cost among all that have room for them; as
the sequences have exactly the room the buffer needs, a piece that fits
nowhere is cut, and its first part fills the sequence of least cost that isn't full.  A buffer ends in
sequences whose sizes are powers of two, which need no padding.

Null texts count as empty; an empty document is its end id alone.  Repeated
rows are packed as often as they occur, and other columns are ignored.  The strings of the
tokenizer's added tokens are those tokens in a text, as the tokenizer itself takes them.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import load, small_batches

#: GPT-2's pre-tokenisation pattern, which belongs to the vocabulary file (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: Runs without a gap from which ranks take quadratic time, and the tokenizer itself is asked.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def encoder(ranks_path: str, tokenizer_path: str):
    """text -> ids of the ``tokenizers`` file, without special tokens added.

    The ranks hold the file's vocabulary and merges; read by ``tiktoken``, they give the same ids four times as
    fast (tests compare them), but take quadratic time for a very long word.
    """
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(tokenizer_path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
    slow = None

    def encode(text: str) -> list[int]:
        nonlocal slow
        if LONG_RUN.search(text) is None:
            return fast.encode(text, allowed_special="all")
        if slow is None:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(tokenizer_path)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def room(tokens: int, capacity: int) -> list[int]:
    """Sizes of the sequences that hold so many tokens without padding."""
    sizes = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    return sizes + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of these lengths: (document, start, length, sequence, offset) for each piece."""
    out, sequence, tails = [], 0, []
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
            start += capacity
        if n > start:
            tails.append((start - n, d, start))
    heapq.heapify(tails)
    left = room(-sum(t[0] for t in tails), capacity)
    sizes, cost = list(left), [0.0] * len(left)
    # pieces never get longer, so a sequence once found to have room has it until it is used
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room, those with less than the pieces so far
    for s, size in enumerate(sizes):
        waiting[size].append(s)
    fits, every, least = [], [(0.0, s) for s in range(len(sizes))], capacity + 1
    while tails:
        n, d, start = heapq.heappop(tails)
        n = -n
        while least > n:
            least -= 1
            for s in waiting[least]:
                if left[s] == least:
                    heapq.heappush(fits, (cost[s], s))
            waiting[least] = []
        if fits:
            s = heapq.heappop(fits)[1]
        else:
            c, s = heapq.heappop(every)
            while not left[s] or c != cost[s]:
                c, s = heapq.heappop(every)
        take = min(n, left[s])
        out.append((d, start, take, sequence + s, sizes[s] - left[s]))
        left[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if left[s]:
            heapq.heappush(every, (cost[s], s))
            if left[s] >= least:
                heapq.heappush(fits, (cost[s], s))
            else:
                waiting[left[s]].append(s)
        if take < n:
            heapq.heappush(tails, (take - n, d, start + take))
    return out


def pack(docs: DataFrame, ranks_path: str, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, buffer_tokens: int = 1 << 22, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text); ``with_ids`` adds the ids as little-endian bytes."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(ranks_path, tokenizer_path)
        base = TaskContext.get().partitionId() << 36
        held, names, count, sequences = [], [], 0, 0

        def emit():
            nonlocal held, names, count, sequences
            pieces = balance([len(x) for x in held], capacity, linear, quadratic)
            fill: dict[int, int] = {}
            for p in pieces:
                fill[p[3]] = fill.get(p[3], 0) + p[2]
            for at in range(0, len(pieces), 8192):
                part = pieces[at : at + 8192]
                bits = [held[d][s : s + n].tobytes() for d, s, n, _, _ in part]
                columns = [
                    pa.array([names[p[0]] for p in part], pa.int64()),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([zlib.crc32(b) for b in bits], pa.int64()),
                    pa.array([len(held[p[0]]) for p in part], pa.int64()),
                    pa.array([base + sequences + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                    pa.array([fill[p[3]] for p in part], pa.int64()),
                ]
                titles = [x.split()[0] for x in SCHEMA.split(", ")]
                if with_ids:
                    columns.append(pa.array(bits, pa.binary()))
                    titles.append("ids")
                yield pa.RecordBatch.from_arrays(columns, titles)
            sequences += len(fill)
            held, names, count = [], [], 0

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                held.append(np.array(ids, "<u4"))
                names.append(name)
                count += len(ids)
                if count >= buffer_tokens:
                    yield from emit()
        if held:
            yield from emit()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def default_files() -> tuple[str, str]:
    """The ranks and the tokenizer file of one vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 1024 tokens."""
    return pack(load(spark, sf_dir, "documents"), *default_files())
