"""Benchmark decontamination: a positional inverted index in document shards, searched from the rarest term of each phrase."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import row_key, stored, without

WINDOW = 10
#: Characters of benchmark text that are searched at once, and whose terms and windows (some 12 bytes a character, in arrays
#: but for the dictionary of terms) go to every task; more text means more rounds, a longer item is a round of its own.
BLOCK_CHARS = 8_000_000
#: Characters of documents in one shard of the index, on average; a longer document is a shard of its own.
SHARD_CHARS = 8_000_000
#: Places in a shard that are compared with windows at once.
_PLACES = 1 << 20
#: How far, in words, the anchors of a proximity match may be displaced.
SLOP = 5

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and takes the words, as UTF-8: bytes beyond ASCII are word bytes, as their characters are. A null text has none."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Phrases:
    """A block of benchmark items: its vocabulary and, by length, its different windows as rows of term numbers.

    Items without words are left out. The items of window k of a length are owners[ends[k - 1]:ends[k]].
    """

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.terms, self.items = window, {}, []
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ids = np.asarray([self.terms.setdefault(w, len(self.terms)) for w in words(text)], dtype=np.int32)
            if len(ids):
                n = min(window, len(ids))
                rows.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(ids, n))
                owners.setdefault(n, []).append(np.full(len(ids) - n + 1, len(self.items), dtype=np.int32))
                self.items.append(str(item))
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in sorted(rows):
            pairs = np.unique(np.hstack([np.concatenate(rows.pop(n)), np.concatenate(owners.pop(n))[:, None]]), axis=0)
            new = np.append(True, (pairs[1:, :n] != pairs[:-1, :n]).any(axis=1))
            windows = np.ascontiguousarray(pairs[new, :n])
            self.by_length.append((windows, np.tile(np.arange(n), (len(windows), 1)), pairs[:, n].copy(), np.append(np.flatnonzero(new)[1:], len(pairs))))

    def rarest_first(self, counts: dict[int, int]) -> None:
        """Order each window's offsets by how often the training documents have the term there."""
        n = np.zeros(len(self.terms) + 1, dtype=np.int64)
        for t, c in counts.items():
            n[t] = c
        self.by_length = [(w, np.lexsort((w, n[w]), axis=1).astype(np.int32), o, e) for w, _, o, e in self.by_length]


def build_shard(texts: list[str | None], terms: dict[bytes, int], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's document starts, its known terms with the ends of their lists, and the lists of positions, one after another.

    Positions count words through the shard, with a gap after each document that no phrase or proximity match can span.
    """
    look, found, starts, at = terms.get, [], [], 0
    for t in texts:
        starts.append(at)
        got = [look(w, -1) for w in words(t)]
        found.append(got)
        at += len(got) + gap
    flat = np.full(at, -1, dtype=np.int32)
    for s, got in zip(starts, found, strict=True):
        flat[s : s + len(got)] = got
    where = np.flatnonzero(flat >= 0)
    order = where[np.argsort(flat[where], kind="stable")]
    ids, counts = np.unique(flat[order], return_counts=True)
    return np.asarray([*starts, at], dtype=np.int64), np.stack([ids, np.cumsum(counts)]).astype(np.int64), order.astype(np.int64)


def search_shard(starts: np.ndarray, ends: np.ndarray, positions: np.ndarray, phrases: Phrases, slop: int) -> tuple[np.ndarray, dict[int, set[str]], dict[int, set[str]]]:
    """(whether each position is hit, items of exact phrases by document number, items of proximity matches) of a shard.

    Windows are grouped by their rarest term. That term's list, shifted by its offset, is where a window may begin; the
    further terms, rarest first, are looked up at their offsets from there, many windows' places at once, until nothing is
    left or all terms agree: an exact phrase. A proximity match has the window's three rarest terms each within slop words
    of its place beside the rarest, whatever the other terms.
    """
    known = len(phrases.terms)
    begin, end = np.zeros(known, dtype=np.int64), np.zeros(known, dtype=np.int64)
    begin[ends[0]], end[ends[0]] = np.append(0, ends[1][:-1]), ends[1]
    size, pad = int(starts[-1]), phrases.window + 2 * slop + 1
    # which term stands where, with room at both ends
    at = np.full(size + 2 * pad + 1, -1, dtype=np.int32)
    at[positions + pad] = np.repeat(ends[0], np.diff(ends[1], prepend=0))
    hit, exact, near = np.zeros(size + 1, dtype=bool), {}, {}

    def put(into: dict[int, set[str]], windows: np.ndarray, places: np.ndarray, owners: np.ndarray, owner_ends: np.ndarray) -> None:
        docs = np.searchsorted(starts, places, side="right") - 1
        for d, k in np.unique(np.stack([docs, windows], axis=1), axis=0).tolist():
            into.setdefault(d, set()).update(phrases.items[o] for o in owners[owner_ends[k - 1] if k else 0 : owner_ends[k]])

    for windows, order, owners, owner_ends in phrases.by_length:
        n = windows.shape[1]
        terms = np.take_along_axis(windows, order, axis=1)
        here = end[terms] > begin[terms]
        # offsets of the three rarest different terms, -1 where there are fewer
        anchors = np.full((len(windows), 3), -1)
        if n == phrases.window:
            later = np.zeros(terms.shape, dtype=bool)
            for k in range(n):
                later[:, k] = (terms[:, :k] == terms[:, k : k + 1]).any(axis=1)
            rank = np.cumsum(~later, axis=1)
            for a in range(3):
                has, k = ((rank == a + 1) & ~later).any(axis=1), ((rank == a + 1) & ~later).argmax(axis=1)
                anchors[has, a] = k[has]
        whole, close = here.all(axis=1), (anchors >= 0).all(axis=1)
        close &= np.where(close, np.take_along_axis(here, np.maximum(anchors, 0), axis=1).all(axis=1), False)
        todo = np.flatnonzero(whole | close)
        todo = todo[np.argsort(terms[todo, 0], kind="stable")]
        length = (end - begin)[terms[todo, 0]]
        cuts = np.searchsorted(np.cumsum(length), np.arange(_PLACES, int(length.sum()) + _PLACES, _PLACES)) + 1
        for part in np.split(todo, np.unique(cuts[cuts < len(todo)])) if len(todo) else ():
            count = (end - begin)[terms[part, 0]]
            w = np.repeat(part, count)
            p = positions[np.repeat(begin[terms[part, 0]] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))]
            keep = whole[w]
            we, pe = w[keep], p[keep] - order[w[keep], 0]
            for k in range(1, n):
                same = at[pe + order[we, k] + pad] == terms[we, k]
                we, pe = we[same], pe[same]
            for k in range(n):
                hit[pe + k] = True
            put(exact, we, pe, owners, owner_ends)
            keep = close[w]
            wc, pc = w[keep], p[keep]
            for a in (1, 2):
                k = anchors[wc, a]
                to, found = pc + order[wc, k] - order[wc, 0] + pad, np.zeros(len(wc), dtype=bool)
                for d in range(-slop, slop + 1):
                    found |= at[to + d] == terms[wc, k]
                wc, pc = wc[found], pc[found]
            put(near, wc, pc, owners, owner_ends)
    return hit, exact, near


_INDEX = "doc_ids binary, keys array<binary>, starts binary, ends binary, positions binary"


def build_index(docs: DataFrame, terms: dict[bytes, int], gap: int, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The index, one row a shard: ids and row keys of its documents, their starts, and the given terms' position lists.

    Each task indexes its documents in runs of about shard_chars, so a shard is bounded and no text is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, texts, size = [], [], [], 0

        def shard():
            starts, ends, positions = build_shard(texts, shared.value, gap)
            known = np.asarray([i is not None for i in ids]).tobytes() + np.asarray([i or 0 for i in ids], dtype=np.int64).tobytes()
            row = [known, starts.tobytes(), ends.tobytes(), np.diff(positions, prepend=0).astype(np.int32).tobytes()]
            row = [pa.array([x], pa.binary()) for x in row]
            return pa.RecordBatch.from_arrays([row[0], pa.array([keys], pa.list_(pa.binary())), *row[1:]], names=["doc_ids", "keys", "starts", "ends", "positions"])

        for batch in batches:
            for i, k, t in zip(*(batch[c].to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                ids.append(i)
                keys.append(k)
                texts.append(t)
                size += len(t or "")
                if size >= shard_chars:
                    yield shard()
                    ids, keys, texts, size = [], [], [], 0
        if ids:
            yield shard()

    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, _INDEX)


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): how often the documents have each indexed term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["ends"].to_pylist():
                ids, ends = np.frombuffer(raw, dtype=np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(ends, prepend=0))], names=["term", "n"])

    return index.select("ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


_FOUND = "doc_id long, key binary, n_words long, hits array<int>, items array<string>, near array<string>"


def search_index(index: DataFrame, phrases: Phrases, gap: int, slop: int = SLOP) -> DataFrame:
    """Matches of the phrases in an index, one row a document: hit word positions, items of exact and of proximity matches."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    types = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in zip(*(batch[c].to_pylist() for c in ("doc_ids", "keys", "starts", "ends", "positions")), strict=True):
                n = len(raw[0]) // 9
                known, ids, keys = np.frombuffer(raw[0][:n], dtype=bool), np.frombuffer(raw[0][n:], dtype=np.int64), raw[1]
                starts, ends = np.frombuffer(raw[2], dtype=np.int64), np.frombuffer(raw[3], dtype=np.int64).reshape(2, -1)
                positions = np.cumsum(np.frombuffer(raw[4], dtype=np.int32), dtype=np.int64)
                hit, exact, near = search_shard(starts, ends, positions, shared.value, slop)
                rows = []
                for d in range(n):
                    a, b = int(starts[d]), int(starts[d + 1]) - gap
                    rows.append((int(ids[d]) if known[d] else None, keys[d], b - a, np.flatnonzero(hit[a:b]).tolist(), sorted(exact.get(d, ())), sorted(near.get(d, set()) - exact.get(d, set()))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "key", "n_words", "hits", "items", "near"])

    return index.mapInArrow(run, _FOUND)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and near_items (arrays), key.

    A window is window consecutive words of an item; an item of fewer words, but not none, is one window. A word inside any
    occurrence of a window is hit. near_items are those with a proximity match and no exact one. Null and empty texts have
    no words; an empty benchmark hits nothing; repeated rows of documents each get a row; a repeated item counts once by
    its id, and one without an id is left out. Many items with one window are its items alike.

    The benchmark is searched in blocks of about block_chars characters, so what goes to every task is bounded. The index
    of a block holds the positions of that block's terms and is written to the shared folder, shard by shard.
    """
    gap = window + 2 * slop + 1
    blocks = -(-(benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) or 1
    found = None
    for k in range(blocks):
        part = benchmark.filter("item_id IS NOT NULL").select("item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        phrases = Phrases(((r.item_id, r.text) for r in part.toLocalIterator()), window)
        index = stored(build_index(docs, phrases.terms, gap), "index")
        phrases.rarest_first({r.term: r.n for r in term_counts(index).toLocalIterator()})
        one = search_index(index, phrases, gap, slop)
        found = one if found is None else found.unionByName(one)
    if blocks > 1:  # rows with one id and text have the same matches; unite the blocks', then give each row its own again
        joined = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        found = found.groupBy("doc_id", "key", "n_words").agg(joined("hits"), joined("items"), joined("near"), (F.count("*") / blocks).cast("int").alias("copies"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "items",
        F.array_except("near", "items").alias("near_items"),
        "key",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that have no word inside an occurrence of a benchmark window."""
    gone = find_contamination(docs, benchmark).filter("contaminated").select(F.col("key").alias("key__")).distinct()
    return without(docs, row_key(), stored(gone, "contaminated"))


#: The contract's columns in DuckDB SQL: document windows of each length that an item window has, joined on their words.
ORACLE = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS p FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, dwin.k, s FROM dwin JOIN win ON dwin.k = win.k AND dwin.p = win.p),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
