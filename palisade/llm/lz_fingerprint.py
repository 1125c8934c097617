"""Lempel-Ziv phrase fingerprints: the hashed set of a text's dictionary phrases as a minimum-hash signature."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import mix64

#: Minimum hashes in a signature, of 16 bits each.
SIZE = 128
#: Documents in one run of neighbours, on average, and how many runs there are at most; more documents make longer runs.
RUN_DOCS, MAX_RUNS = 1024, 20_000
_LEAST = -(1 << 63)  # stands for a null id
_BLOCK = 2048  # phrase hashes that are permuted at once
_POWER = np.uint64(0x9E3779B97F4A7C15)
_MULT = mix64(np.arange(1, SIZE + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix64(np.arange(SIZE + 1, 2 * SIZE + 1, dtype=np.uint64))

Signature = np.ndarray  # uint64 minima, all bits set where there is no phrase


def parse(data: bytes, trie: dict[int, int], nodes: int, node: int) -> tuple[list[int], list[int], int, int]:
    """Go on parsing data from a state (trie, number of nodes, node reached): (ends of new phrases, trie keys added, number of nodes, node).

    A phrase is the longest known one plus a byte; it then is known itself. The trie maps node * 256 + byte to a node.
    """
    ends, added, get = [], [], trie.get
    for at, byte in enumerate(data):
        key = node << 8 | byte
        node = get(key, 0)
        if not node:
            nodes += 1
            trie[key] = nodes
            added.append(key)
            ends.append(at + 1)
    return ends, added, nodes, node


def phrase_hashes(data: bytes, begin: int, ends: list[int], tail: bool) -> np.ndarray:
    """Hashes of the phrases data[begin:ends[0]], data[ends[0]:ends[1]], ... and, with tail, of what is left."""
    cut = [begin, *ends]
    if tail and cut[-1] < len(data):
        cut.append(len(data))
    cut = np.asarray(cut)
    if len(cut) < 2:
        return np.empty(0, dtype=np.uint64)
    b = np.frombuffer(data, dtype=np.uint8)[begin : cut[-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(b)) - np.repeat(cut[:-1] - begin, np.diff(cut))  # place in its phrase
    # a phrase's hash: the sum of its bytes, each mixed with its place
    sums = np.add.reduceat(mix64(b * _POWER + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), cut[:-1] - begin)
    return mix64(sums + np.diff(cut).astype(np.uint64))


def minima(hashes: np.ndarray, start: Signature | None = None) -> Signature:
    out = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64) if start is None else start.copy()
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        np.minimum(out, (part[None, :] * _MULT[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out


def short(sig: Signature) -> np.ndarray:
    """Sixteen mixed bits of each minimum."""
    return (mix64(sig) >> np.uint64(48)).astype(np.uint16)


def to_text(sig: Signature) -> str:
    return base64.b64encode(short(sig).astype("<u2").tobytes()).decode()


def likeness(a: Signature, b: Signature) -> float:
    """The share of equal minima, which estimates the Jaccard similarity of the phrase sets; 1 for two empty texts."""
    return float((short(a) == short(b)).mean())


def fingerprint(text: str | None) -> Signature:
    """The signature of a whole text; a null text counts as empty and has no phrase."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ends, *_ = parse(data, {}, 0, 0)
    return minima(phrase_hashes(data, 0, ends, True))


def with_edit(text: str, kept: int, new_tail: str) -> tuple[Signature, Signature]:
    """Signatures of text and of its first kept code points followed by new_tail; their common start is parsed once."""
    head, old, new = (x.encode("utf-8", "surrogatepass") for x in (text[:kept], text[kept:], new_tail))
    trie: dict[int, int] = {}
    ends, _, nodes, node = parse(head, trie, 0, 0)
    common, begin = minima(phrase_hashes(head, 0, ends, False)), ends[-1] if ends else 0
    out = []
    for tail in (old, new):
        more, added, *_ = parse(tail, trie, nodes, node)
        out.append(minima(phrase_hashes(head[begin:] + tail, 0, [e + len(head) - begin for e in more], True), common))
        for key in added:
            del trie[key]
    return out[0], out[1]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, run_docs: int = RUN_DOCS) -> DataFrame:
    """Per document row: its fingerprint, that of an edited text, and how like they and the next document's are (see _OUT).

    The edited text has the last floor(n_chars / 4) code points replaced by as many first ones (or all) of the next
    document in the order of doc_id (nulls first, equal ids by a hash of the text); after the last row comes the first. A null text is
    empty; a single row is its own next one; an empty table gives no row.

    Rows are dealt by ranges of doc_id, and of a hash of the text where many share an id or have none, into at most MAX_RUNS
    runs of about run_docs, and the first row of each run also goes to the run before it, so no task needs more than its own
    run, which it reads row by row. What reaches the driver is one cut and one first row's key a run, however many rows
    there are. Rows alike in id and text stay together.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    if not n:
        return docs.sparkSession.createDataFrame([], _OUT)
    runs = min(MAX_RUNS, -(-n // run_docs))
    cuts = run_cuts(d, runs, n, nulls)
    d = d.withColumn("run", _run_of(cuts))
    nulls_first = F.coalesce("doc_id", F.lit(_LEAST))
    first = [(r.run, *r.low) for r in d.groupBy("run").agg(F.min(F.struct(nulls_first, "h")).alias("low")).orderBy("run").collect()]
    halo = docs.sparkSession.createDataFrame([(*f, first[k - 1][0]) for k, f in enumerate(first)], "run long, low long, low_h long, before long")
    extra = d.join(F.broadcast(halo), "run").filter((nulls_first == F.col("low")) & (F.col("h") == F.col("low_h")))
    extra = extra.select("doc_id", "text", "h", F.col("before").alias("run"), F.lit(True).alias("halo"))
    dealt = d.withColumn("halo", F.lit(False)).unionByName(extra).repartition(len(first), "run").sortWithinPartitions("run", "halo", "doc_id", "h", "text")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in _OUT.split(", ")]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(run, id, text, next text) of each row that isn't a halo."""
        run, before, closed = None, None, False
        for b in batches:
            for r, halo, i, t in zip(*(b[c].to_pylist() for c in ("run", "halo", "doc_id", "text")), strict=True):
                if r != run:
                    run, before, closed = r, None, False
                if closed:  # further rows with the next run's first id
                    continue
                if before is not None:
                    yield (run, *before, t)
                before, closed = (i, t), halo

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting = [], None  # waiting: a row without its next one's signature

        def finish(next_sig: Signature) -> None:
            _, i, t, sig, edited, edited_sig, _ = waiting
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((i, len(t), sha, to_text(sig), to_text(edited_sig), likeness(sig, edited_sig), likeness(sig, next_sig)))

        for run, i, t, following in neighbours(batches):
            kept = len(t) - len(t) // 4
            tail = following[: len(t) - kept]
            sig, edited_sig = with_edit(t, kept, tail)
            if waiting:
                finish(sig if waiting[0] == run else fingerprint(waiting[-1]))
            waiting = (run, i, t, sig, t[:kept] + tail, edited_sig, following)
            if len(rows) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows.clear()
        if waiting:
            finish(fingerprint(waiting[-1]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(go, _OUT)


def run_cuts(d: DataFrame, runs: int, n: int, nulls: int) -> list[tuple[int, int]]:
    """At most about runs sorted pairs (id, hash) that cut rows (doc_id, h) into runs of about n / runs rows.

    An id that several quantiles fall on is cut by even steps of the hash, and so are the rows without id.
    """
    if runs < 2:
        return []
    at = d.stat.approxQuantile("doc_id", [k / runs for k in range(1, runs)], 0.1 / runs) if nulls < n else []
    ids = Counter(map(int, at))
    if nulls:
        ids[_LEAST] += nulls * runs // n
    out = []
    for i, times in ids.items():
        # the first cut is at the id itself, further ones at even steps of the hash
        out += [(i, _LEAST + (1 << 64) * k // times) for k in range(times)] if times else []
    return sorted(set(out))


def _run_of(cuts: list[tuple[int, int]]):
    """How many cuts lie at or below (doc_id, h). Only these two go to Python, for a binary search."""
    if not cuts:
        return F.lit(0).cast("long")
    ids, first = np.unique(np.asarray([i for i, _ in cuts], dtype=np.int64), return_index=True)
    steps, ends = np.asarray([h for _, h in cuts], dtype=np.int64), np.append(first, len(cuts))

    @F.pandas_udf("long")
    def run_of(doc_ids: pd.Series, hashes: pd.Series) -> pd.Series:
        i, h = doc_ids.to_numpy(dtype=np.int64), hashes.to_numpy(dtype=np.int64)
        before = np.searchsorted(ids, i, side="right")
        out = ends[before].copy()
        for k in np.unique(before[before > 0]) - 1:  # ids that several cuts fall on
            if ends[k + 1] - first[k] > 1 and (mine := i == ids[k]).any():
                out[mine] = first[k] + np.searchsorted(steps[first[k] : ends[k + 1]], h[mine], side="right")
        return pd.Series(out)

    return run_of(F.coalesce("doc_id", F.lit(_LEAST)), "h")
