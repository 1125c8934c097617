"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import BROADCAST_KEYS, stored

#: Documents in a group, on average. Only a group's tails of less than a sequence are held.
GROUP_DOCS = 2048
#: Partitions that the groups are dealt to, at most; a task packs its groups one after another.
MAX_PARTITIONS = 20_000
#: Cached words of the tokenizer; when there are more, the cache starts afresh.
CACHE_WORDS = 400_000
TOKENIZER = "byte_bpe_50k"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteBpe:
    """Ids of the tokenizers file, two bytes each, word by word through a bounded cache.

    A space always begins a word of the pre-tokenizer unless white space stands on both of its sides, so texts without
    such spaces may be cut before each space and every piece looked up. Other texts, and those with a special token's
    string or letters beyond Latin script, go to the tokenizer itself.
    """

    _plain = re.compile("[\x00-ɏ‐-›]*")
    _odd = re.compile(r"\s \s|  |<\|")

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    def _word(self, w: str) -> bytes:
        got = self.cache[w] = np.asarray(self.words(" " + w), dtype="<u2").tobytes()
        return got

    def ids(self, text: str) -> np.ndarray:
        """The text's ids as little-endian unsigned 16-bit integers."""
        if not text:
            return np.empty(0, dtype="<u2")
        if self._odd.search(text) or not self._plain.fullmatch(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2")
        first, *rest = text.split(" ")
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        out, get, word = [np.asarray(self.words(first), dtype="<u2").tobytes()], self.cache.get, self._word
        out += [get(w) or word(w) for w in rest]
        return np.frombuffer(b"".join(out), dtype="<u2")


class CapacityTree:
    """A tournament tree: each inner node holds the largest free capacity below it, so the first bin that fits is found in log(n) steps."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1
        while self.size < max(1, bins):
            self.size *= 2
        self.free = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """Puts need into the first bin with room and returns that bin."""
        free, i = self.free, 1
        while i < self.size:
            i *= 2
            if free[i] < need:
                i += 1
        free[i] -= need
        leaf = i - self.size
        i //= 2
        while i:
            a, b = free[2 * i], free[2 * i + 1]
            top = a if a > b else b
            if free[i] == top:
                break
            free[i] = top
            i //= 2
        return leaf


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Equal lengths keep their order. At worst every item has a bin of its own."""
    tree, bins = CapacityTree(len(lengths), capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = tree.first_fit(lengths[i])
        while b >= len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def fill(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, length): first-fit decreasing, then the emptiest bins are cut up to fill the gaps of the others.

    What is left over is cut into sequences whose lengths are powers of two, which need no padding.
    """
    bins = first_fit_decreasing(lengths, capacity)
    seqs = [[(i, 0, lengths[i]) for i in b] for b in bins]
    room = [capacity - sum(lengths[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (room[b], b))  # fullest first
    lo = 0
    while lo < len(order) and room[order[lo]] == 0:
        lo += 1
    hi = len(order) - 1
    while hi > lo:
        donor = order[hi]
        while seqs[donor] and lo < hi:
            to = order[lo]
            i, at, n = seqs[donor].pop()
            take = min(n, room[to])
            seqs[to].append((i, at, take))
            room[to] -= take
            room[donor] += take
            if take < n:
                seqs[donor].append((i, at + take, n - take))
            if room[to] == 0:
                lo += 1
        if not seqs[donor]:
            hi -= 1
    out = [s for b, s in enumerate(seqs) if s and room[b] == 0]
    for rest in (s for b, s in enumerate(seqs) if s and room[b]):
        left = capacity - sum(n for _, _, n in rest)
        total = capacity - left
        size = 1 << (total.bit_length() - 1)
        rest, now, got = rest[::-1], [], 0
        while rest:
            i, at, n = rest.pop()
            take = min(n, size - got)
            now.append((i, at, take))
            got += take
            if take < n:
                rest.append((i, at + take, n - take))
            if got == size:
                out.append(now)
                total -= size
                now, got, size = [], 0, 1 << max(0, total.bit_length() - 1)
    return out


def _pack_group(group: int, rows: Iterator[tuple], bpe: ByteBpe, capacity: int, out: list[list]) -> None:
    """Appends the group's pieces to the columns out; whole sequences at once, tails after first-fit decreasing."""
    ids_, starts, tails, lengths, totals = [], [], [], [], []
    seq = group << 32
    crc = zlib.crc32

    def put(doc, start, part, total, seq, offset):
        for c, v in zip(out, (doc, start, len(part), crc(part.astype("<u4").tobytes()), total, seq, offset), strict=True):
            c.append(v)

    for doc, text in rows:
        ids = np.append(bpe.ids(text or ""), np.zeros(1, dtype="<u2"))
        n = len(ids)
        whole = n - n % capacity
        for at in range(0, whole, capacity):
            put(doc, at, ids[at : at + capacity], n, seq, 0)
            seq += 1
        if whole < n:
            ids_.append(doc)
            starts.append(whole)
            tails.append(ids[whole:].copy())
            lengths.append(n - whole)
            totals.append(n)
    for s in fill(lengths, capacity):
        offset = 0
        for i, at, n in s:
            put(ids_[i], starts[i] + at, tails[i][at : at + n], totals[i], seq, offset)
            offset += n
        seq += 1


def one_by_one(rows: DataFrame) -> DataFrame:
    """(doc_id, text, copy) of rows (doc_id, text): copy numbers those that are alike in both from 1.

    Only rows whose doc_id occurs more than once are grouped, with map-side combination; the ids themselves are a narrow column.
    """
    again = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(1))
    if again.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        again = F.broadcast(again)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    again = again.withColumnRenamed("doc_id", "again")
    counted = rows.join(again, same, "left_semi").groupBy("doc_id", "text").agg(F.count("*").cast("int").alias("n"))
    copies = counted.select("doc_id", "text", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    return rows.join(again, same, "left_anti").withColumn("copy", F.lit(1)).unionByName(copies)


def pack(docs: DataFrame, tokenizer_dir_names: tuple[str, str, str] | None = None, capacity: int = 1024, group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """Pieces of all documents in sequences of at most capacity ids (see PIECES).

    Documents are dealt by a seeded hash of (doc_id, text) into groups of about group_docs, each packed on its own, so a
    lost task repeats its groups only. Rows that are alike in both are counted first and their copies dealt one by one.
    A null text counts as empty and has the closing id 0 alone; equal rows each get their own
    pieces; an empty table gives no piece. Within a group, rows are taken in the order of doc_id and text, nulls first.
    tokenizer_dir_names: paths of the JSON file and of the ranks file, and the pre-tokenizer's pattern; by default those of public_tokenizers.
    """
    if tokenizer_dir_names is None:
        import public_tokenizers as P

        tokenizer_dir_names = (P.path(f"{TOKENIZER}.json"), P.path(f"{TOKENIZER}.tiktoken"), P.PATTERN)
    rows = one_by_one(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    groups = max(1, -(-docs.count() // group_docs))
    dealt = rows.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "copy"), F.lit(groups)).alias("g"))
    dealt = dealt.repartition(min(groups, MAX_PARTITIONS), "g").sortWithinPartitions("g", "doc_id", "text")
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*tokenizer_dir_names)
        out: list[list] = [[] for _ in schema]

        def flat():
            for batch in batches:
                yield from zip(batch["g"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)

        for now, rows in groupby(flat(), key=lambda r: r[0]):
            _pack_group(now, ((d, t) for _, d, t in rows), bpe, capacity, out)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
            out = [[] for _ in schema]

    return dealt.mapInArrow(run, PIECES)
