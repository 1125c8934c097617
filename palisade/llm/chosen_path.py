"""N-gram Jaccard self-join by chosen paths: sets are split again and again on sampled shared tokens, small buckets are compared, and whatever looks alike is verified exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Forest, components, mix64, row_key, stored, without

SHINGLE = 5
THRESHOLD = 0.8
#: Share of the pairs at the threshold itself that the runs should find at least, however often their buckets are split;
#: more similar pairs, and pairs in buckets that are soon small, are found more often.
RECALL = 0.99
#: Splits before the first look at bucket sizes, and in all; what is still large then is a candidate group as it is.
DEPTH, MAX_DEPTH = 2, 5
#: Sets up to which a bucket is compared at once; a larger one is split again.
SMALL = 128
SKETCH = 64
#: Sketches that agree in fewer places are not verified. At similarity 0.8, 64 places agree in fewer than 38 of them once in 5,000 times.
LOOKS_ALIKE = 38
#: In a large bucket, sets whose sketch agrees with that of the bucket's least set in so many places need no further split ...
WITH_LEAST = 48
#: ... as they are linked to it, and whatever looks like them agrees with it in so many places and is linked to it, too.
NEAR_LEAST = WITH_LEAST + LOOKS_ALIKE - SKETCH
#: Sets, and shingles of all of them, in a block of the exact comparison.
VERIFY_BLOCK, VERIFY_SHINGLES = 1024, 1 << 21
#: Tokens that are hashed at once below the nodes of a set's paths.
_TOKENS_AT_ONCE = 1 << 15
#: Large-bucket tables of up to this many rows (about 100 bytes each) are broadcast, and so are tables of candidates.
BROADCAST_BUCKETS = 100_000
BROADCAST_MEMBERS = 250_000

_WORD = re.compile(r"\w+")
_SEEDS = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of n lower-case words. Fewer words, but not none, make one shingle."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(h, words), dtype=np.uint64, count=len(words))
    n = min(n, len(w))
    out = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix64(out + w[i : len(w) - n + 1 + i] + np.uint64(n))
    return np.unique(out)


def runs_for(recall: float, depth: int | None = None) -> int:
    """Runs after which a pair at the threshold is found with the given probability, even if all its buckets are split depth times.

    Such a pair shares a Poisson number of chosen children of mean 1 at least at each split, so a run misses it with the
    probability that this branching process has died out by then.
    """
    dead = 0.0
    for _ in range(MAX_DEPTH if depth is None else depth):
        dead = float(np.exp(dead - 1))
    return ceil(log(1 - recall) / log(dead))


def _low(x: np.ndarray) -> np.ndarray:
    return x & np.uint64(0xFFFFFFFF)


def chosen(nodes: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the node, 32-bit mark of the token) for each token chosen below each node: its hash there is less than 1 / (threshold * size)."""
    limit = np.uint64(min(int(min(1.0, 1 / (threshold * len(tokens))) * 2.0**64), 2**64 - 1))
    odd, at, marks = nodes | np.uint64(1), [], []
    for lo in range(0, len(tokens), _TOKENS_AT_ONCE):
        part = tokens[lo : lo + _TOKENS_AT_ONCE]
        i, j = np.nonzero(part[None, :] * odd[:, None] <= limit)
        at.append(i)
        marks.append(_low(mix64(nodes[i] ^ part[j])))
    return np.concatenate(at), np.concatenate(marks)


def child(nodes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return mix64(nodes ^ marks)


def paths(tokens: np.ndarray, runs: int, threshold: float = THRESHOLD, depth: int | None = None, max_depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A set's nodes after depth splits over all runs, the steps below them down to max_depth splits, node by node, and how many each has.

    A step is a parent's lower 32 bits beside the mark of a token chosen there; child() gives the node it leads to.
    """
    depth, max_depth = DEPTH if depth is None else depth, MAX_DEPTH if max_depth is None else max_depth
    nodes = mix64(np.arange(1, runs + 1, dtype=np.uint64))
    for _ in range(depth):
        if len(nodes):
            at, marks = chosen(nodes, tokens, threshold)
            nodes = np.unique(child(nodes[at], marks))
    top, level = nodes, np.arange(len(nodes))  # level: the top node that each node is below
    steps, owners = [], []
    for _ in range(max_depth - depth):
        if not len(nodes):
            break
        at, marks = chosen(nodes, tokens, threshold)
        level = level[at]
        steps.append((_low(nodes[at]) << np.uint64(32)) | marks)
        owners.append(level)
        nodes = child(nodes[at], marks)
    owner = np.concatenate(owners) if owners else np.empty(0, dtype=np.int64)
    order = np.argsort(owner, kind="stable")
    flat = np.concatenate(steps)[order] if steps else np.empty(0, dtype=np.uint64)
    return top, flat, np.bincount(owner, minlength=len(top))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One byte of each of SKETCH minimum hashes."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(tokens), 4096):
        part = tokens[at : at + 4096]
        np.minimum(out, ((part[None, :] ^ _SEEDS[:, None]) * (_SEEDS[:, None] | np.uint64(1))).min(axis=1), out=out)
    return (mix64(out) >> np.uint64(56)).astype(np.uint8)


_BASE = "doc_id long, key binary, sig binary, size long, sketch binary, buckets array<struct<bucket:long,steps:array<long>>>"


def _batch(cols: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def describe(docs: DataFrame, runs: int, n: int, threshold: float) -> DataFrame:
    """Per document row: its id and key, a digest of its shingle set (null if it has none) and its size, the sketch and the ends of its paths with the steps below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, size, sk, tops, steps, counts = [], [], [], [], [], []
            for t in b["text"].to_pylist():
                s = shingles(t, n)
                size.append(len(s))
                top, below, per = paths(s, runs, threshold) if len(s) else (s, s, np.empty(0, dtype=np.int64))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sk.append(sketch(s).tobytes() if len(s) else None)
                tops.append(top)
                steps.append(below)
                counts.append(per)
            ends = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            below = pa.ListArray.from_arrays(ends(np.concatenate(counts)), pa.array(np.concatenate(steps).view(np.int64)))
            nodes = pa.StructArray.from_arrays([pa.array(np.concatenate(tops).view(np.int64)), below], names=["bucket", "steps"])
            buckets = pa.ListArray.from_arrays(ends([len(x) for x in tops]), nodes)
            cols = [b["doc_id"], b["key"], pa.array(sig, pa.binary()), pa.array(size, pa.int64()), pa.array(sk, pa.binary()), buckets]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "sig", "size", "sketch", "buckets"])

    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, _BASE)


_SPLIT = "sig binary, sketch binary, below array<struct<bucket:long,steps:array<long>>>, near array<binary>"


def _lists(owners: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """values, sorted by owner, as one list for each of n owners."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owners, minlength=n))), pa.int32()), values)


def split_again(rows: DataFrame) -> DataFrame:
    """(sig, sketch, below, near) of sets in large buckets: rows (sig, sketch, bucket, steps, low, low_sketch) that follow one another by set.

    A set near a bucket's least one gives a candidate link to it, once; one very near it ends there, so a crowd of near
    copies isn't split on and on. The others go on to the buckets below on their paths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sk, low = (np.frombuffer(b"".join(b[c].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH) for c in ("sketch", "low_sketch"))
            agree = (sk == low).sum(axis=1)
            node = b["bucket"].to_numpy(zero_copy_only=False).view(np.uint64)
            lists = b["steps"]
            lists = lists if isinstance(lists, pa.ListArray) else lists.cast(pa.list_(pa.int64()))
            step = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
            take = ((step >> np.uint64(32)) == _low(node[row])) & (agree[row] < WITH_LEAST)
            sig, least, number = b["sig"].to_pylist(), b["low"].to_pylist(), {}
            owner = np.asarray([number.setdefault(x, len(number)) for x in sig])
            r, marks = row[take], _low(step[take])
            by_set = np.argsort(owner[r], kind="stable")
            r, marks = r[by_set], marks[by_set]
            below = pa.StructArray.from_arrays([pa.array(child(node[r], marks).view(np.int64)), lists.take(pa.array(r))], names=["bucket", "steps"])
            linked = {(owner[i], least[i]): i for i in np.flatnonzero(agree >= NEAR_LEAST).tolist() if sig[i] != least[i]}
            linked = np.asarray(sorted(linked.values(), key=lambda i: owner[i]), dtype=np.int64)
            n, first = len(number), pa.array(np.unique(owner, return_index=True)[1])
            near = _lists(owner[linked], n, b["low"].take(pa.array(linked)).cast(pa.binary()))
            out = pa.RecordBatch.from_arrays([b["sig"].take(first), b["sketch"].take(first), _lists(owner[r], n, below), near], names=["sig", "sketch", "below", "near"])
            some = (np.bincount(owner[r], minlength=n) > 0) | (np.bincount(owner[linked], minlength=n) > 0)
            yield out.filter(pa.array(some))

    return rows.select("sig", "sketch", "bucket", "steps", "low", "low_sketch").mapInArrow(run, _SPLIT)


def compare_small(rows: DataFrame) -> DataFrame:
    """Candidate links (a, b) inside buckets of at most SMALL sets: of all pairs whose sketches look alike, a spanning forest."""

    def links(sigs: list[bytes], sk: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        x = np.frombuffer(b"".join(sk), dtype=np.uint8).reshape(-1, SKETCH)
        alike = (x[:, None, :] == x[None, :, :]).sum(axis=2) >= LOOKS_ALIKE
        forest = Forest(len(sigs))
        for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
            if forest.join(int(i), int(j)):
                yield sigs[i], sigs[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sigs, sk, a, b_ = None, [], [], [], []

        def flush():
            if len(sigs) > 1:
                for p, q in links(sigs, sk):
                    a.append(p)
                    b_.append(q)

        for b in batches:
            for k, s, x in zip(b["bucket"].to_pylist(), b["sig"].to_pylist(), b["sketch"].to_pylist(), strict=True):
                if k != bucket:
                    flush()
                    bucket, sigs, sk = k, [], []
                sigs.append(s)
                sk.append(x)
            if len(a) >= 4096:
                yield _batch([a, b_], [pa.binary(), pa.binary()], ["a", "b"])
                a.clear()
                b_.clear()
        flush()
        if a:
            yield _batch([a, b_], [pa.binary(), pa.binary()], ["a", "b"])

    return rows.select("bucket", "sig", "sketch").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a binary, b binary")


def candidate_links(reps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct sets such that, but for the recall, similar sets are connected.

    Buckets are counted with map-side combination. Those of more than SMALL sets never meet in one task: their rows go on to
    the next tokens of their paths where they are. What is still large after MAX_DEPTH splits is linked to its least set unseen.
    """
    rows, found, depth = reps.select("sig", "sketch", F.explode("buckets").alias("b")).select("sig", "sketch", "b.bucket", "b.steps"), None, DEPTH
    while True:
        sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.xxhash64("sig")).alias("least")).filter(f"n > {SMALL}").select("bucket", "least"), "large")
        n_large = sizes.count()
        hint = F.broadcast if n_large <= BROADCAST_BUCKETS else (lambda x: x)
        small = compare_small(rows.join(hint(sizes.select("bucket")), "bucket", "left_anti") if n_large else rows)
        found = small if found is None else found.unionByName(small)
        if not n_large:
            break
        # a bucket's least set is the one with the least hash; should two share it, the least of them
        low = reps.select(F.xxhash64("sig").alias("least"), "sig", "sketch").join(hint(sizes), "least").groupBy("bucket").agg(F.min(F.struct("sig", "sketch")).alias("low"))
        low = stored(low.select("bucket", F.col("low.sig").alias("low"), F.col("low.sketch").alias("low_sketch")), "least")
        large = rows.join(hint(low), "bucket")
        if depth >= MAX_DEPTH:
            found = found.unionByName(large.select(F.col("sig").alias("a"), F.col("low").alias("b")))
            break
        split = stored(split_again(large), "split")
        found = found.unionByName(split.select(F.col("sig").alias("a"), F.explode("near").alias("b")))
        rows = split.select("sig", "sketch", F.explode("below").alias("b")).select("sig", "sketch", "b.bucket", "b.steps")
        depth += 1
    return found


def token_sets(members: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(comp, blocks, mine, sig, weight, tokens) of members (comp, sig, size, low: key of a row with that set, weight: how many there are).

    A group of more than VERIFY_BLOCK sets, or VERIFY_SHINGLES shingles, is cut into blocks by a hash; mine is a set's block.
    """
    blocks = F.greatest(F.ceil(F.count("*") / VERIFY_BLOCK), F.ceil(F.sum("size") / VERIFY_SHINGLES)).cast("int")
    sized = stored(members.join(members.groupBy("comp").agg(blocks.alias("blocks")), "comp"), "members")
    if sized.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS:
        sized = F.broadcast(sized)
    texts = docs.select(row_key().alias("low"), "text").join(sized, "low")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, keep = [], []
            for t, s in zip(b["text"].to_pylist(), b["sig"].to_pylist(), strict=True):
                x = shingles(t, n)
                keep.append(len(x) > 0 and xxhash.xxh3_128_digest(x.tobytes()) == s)  # should two rows' keys be equal by chance
                tokens.append(x.tobytes())
            out = pa.RecordBatch.from_arrays([b["comp"], b["blocks"], b["sig"], b["weight"], pa.array(tokens, pa.binary())], names=["comp", "blocks", "sig", "weight", "tokens"])
            yield out.filter(pa.array(keep))

    s = texts.select("comp", "blocks", "sig", "weight", "text").mapInArrow(sets, "comp binary, blocks int, sig binary, weight long, tokens binary")
    return s.withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))


_VERIFIED = "a binary, b binary, links long"


def compare(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact links of rows (comp, x, y, left, right, sig, weight, tokens): inside each (comp, x, y), those between left and right rows.

    Returns rows (a, null, links): documents that set a is linked to there, and rows (a, b, 0): a spanning forest of the links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for b in batches:
                yield from zip(*(b[c].to_pylist() for c in ("comp", "x", "y", "left", "right", "sig", "weight", "tokens")), strict=True)

        a, b_, links = [], [], []
        for _, group in groupby(flat(), key=lambda r: r[:3]):
            seen: dict[bytes, tuple[bool, bool, int, np.ndarray]] = {}
            for _, _, _, left, right, sig, weight, tokens in group:  # equal sets from several rows with one key are one
                old = seen.get(sig, (False, False))
                seen[sig] = (left or old[0], right or old[1], weight, np.frombuffer(tokens, dtype=np.uint64))
            if len(seen) > 1:
                for p, q, w in exact_links([(s, *v) for s, v in seen.items()], threshold):
                    a.append(p)
                    b_.append(q)
                    links.append(w)
            if len(a) >= 4096:
                yield _batch([a, b_, links], [pa.binary(), pa.binary(), pa.int64()], ["a", "b", "links"])
                a, b_, links = [], [], []
        if a:
            yield _batch([a, b_, links], [pa.binary(), pa.binary(), pa.int64()], ["a", "b", "links"])

    s = sets.select("comp", "x", "y", "left", "right", "sig", "weight", "tokens").repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y")
    return s.mapInArrow(run, _VERIFIED)


def exact_links(sets: list[tuple[bytes, bool, bool, int, np.ndarray]], threshold: float) -> Iterator[tuple[bytes, bytes | None, int]]:
    """Links between left and right ones of (signature, left, right, weight, sorted tokens)."""
    n, size = len(sets), np.asarray([len(s[4]) for s in sets])
    left, right = (np.flatnonzero([s[k] for s in sets]) for k in (1, 2))
    tokens, owner = np.concatenate([s[4] for s in sets]), np.repeat(np.arange(n), size)
    _, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[code] > 1  # a token of one set meets no other
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both, codes = np.zeros((len(left), len(right)), dtype=np.float32), int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, codes, 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        m = np.zeros((n, min(4096, codes - lo)), dtype=np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        both += m[left] @ m[right].T
    # J >= t, with integers on the left: both >= t * (|x| + |y| - both)
    linked = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9
    linked &= left[:, None] != right[None, :]
    weight, total = np.asarray([s[3] for s in sets]), np.zeros(n, dtype=np.int64)
    total[left] += (linked * weight[right][None, :]).sum(axis=1)
    if not (len(left) == len(right) and (left == right).all()):  # two sides: what is seen from the left counts for the right as well
        total[right] += (linked * weight[left][:, None]).sum(axis=0)
    for i in np.flatnonzero(total).tolist():
        yield sets[i][0], None, int(total[i])
    forest = Forest(n)
    for i, j in zip(*np.nonzero(linked), strict=True):
        if forest.join(int(left[i]), int(right[j])):
            yield sets[left[i]][0], sets[right[j]][0], 0


def all_links(sets: DataFrame, threshold: float) -> DataFrame:
    """Every link inside the groups, each pair of sets compared once: a block with itself, and each pair of blocks, is a task's work."""
    s = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    s = s.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")})
    return compare(s.withColumns({"left": F.col("mine") == F.col("x"), "right": F.col("mine") == F.col("y")}), threshold)


def class_links(sets: DataFrame, threshold: float) -> DataFrame:
    """Links that connect what links connect, without comparing every pair of a large group of near copies.

    First each block is compared with its group's first block alone, which is as much work as there are sets. In groups of
    several blocks the sets that are then outside their group's largest class are compared with the whole group: any other
    link that matters joins two classes, and of these one at least isn't the largest.
    """
    to = F.when(F.col("mine") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine"))
    s = sets.withColumn("y", F.explode(to)).withColumn("x", F.lit(0))
    first = stored(compare(s.withColumns({"left": F.col("mine") == 0, "right": F.col("mine") == F.col("y")}), threshold), "first_links").filter("b IS NOT NULL")
    several = sets.filter("blocks > 1")
    if several.isEmpty():
        return first
    classes = components(first.select("a", "b"))
    of = several.select("comp", "blocks", "sig").join(classes.withColumnRenamed("node", "sig"), "sig", "left").select("comp", "blocks", "sig", F.coalesce("root", "sig").alias("root"))
    of = stored(of, "classes")
    largest = of.groupBy("comp", "root").agg(F.count("*").alias("n")).groupBy("comp").agg(F.max(F.struct("n", "root")).alias("top"))
    loose = of.join(largest, "comp").filter("root != top.root")
    loose = loose.join(loose.groupBy("comp").agg(F.ceil(F.count("*") / VERIFY_BLOCK).cast("int").alias("loose_blocks")), "comp")
    loose = stored(loose.select("comp", "sig", "loose_blocks"), "loose")
    if loose.isEmpty():
        return first
    left = several.join(loose.select("sig", "loose_blocks"), "sig").withColumn("x", F.pmod(F.xxhash64("sig"), F.col("loose_blocks")).cast("int"))
    left = left.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"left": F.lit(True), "right": F.lit(False)})
    right = several.join(loose.select("comp", "loose_blocks").distinct(), "comp").withColumn("y", F.col("mine"))
    right = right.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("loose_blocks") - 1))).withColumns({"left": F.lit(False), "right": F.lit(True)})
    cols = ["comp", "x", "y", "left", "right", "sig", "weight", "tokens"]
    second = stored(compare(left.select(*cols).unionByName(right.select(*cols)), threshold), "second_links").filter("b IS NOT NULL")
    return first.unionByName(second)


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL, count_links: bool = True) -> DataFrame:
    """Per document row: doc_id, class_id, n_links, and key and first_key (the row's key and that of the class's first row).

    Two documents are linked if the Jaccard similarity of their sets of n-word shingles is at least threshold; equal sets
    always are. A class is a connected component of links; class_id is its smallest doc_id (nulls last), n_links how many other rows the
    row is linked to. Texts without words (null and empty ones too) have no links and are classes of their own. Rows that
    are repeated are linked to each other. Long texts are compared whole.

    Equal sets are joined into one first, with their count, so copies are never paired. Links between distinct sets are
    found by chosen paths and sketches, then verified exactly inside candidate groups: to count links every pair of a group
    is compared, in blocks. Without count_links (n_links is null then) only what decides on the classes is (see class_links).
    """
    base = stored(describe(docs, runs_for(recall), n, threshold), "sets")
    full = base.filter("sig IS NOT NULL")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("low")
    reps = stored(full.groupBy("sig").agg(F.count("*").alias("weight"), low, F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets")), "distinct")
    groups = components(candidate_links(reps))
    members = groups.select(F.col("node").alias("sig"), F.col("root").alias("comp")).join(reps.select("sig", "size", F.col("low.key").alias("low"), "weight"), "sig")
    sets = stored(token_sets(stored(members, "grouped"), docs, n), "tokens")
    verified = stored(all_links(sets, threshold), "verified") if count_links else class_links(sets, threshold)
    classes = components(verified.filter("b IS NOT NULL").select("a", "b"))
    of = reps.select("sig", "low", "weight").join(classes.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    of = stored(of, "of")
    least = stored(of.groupBy("root").agg(F.min("low").alias("first"), F.sum("weight").alias("rows")), "least")
    of = of.join(least, "root")
    if count_links:
        links = verified.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
        of = of.join(links.withColumnRenamed("a", "sig"), "sig", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1)
    else:
        of = of.withColumn("n_links", F.lit(None).cast("long"))
    # only sets that occur more than once or have a link need to be looked up
    of = stored(of.filter("rows > 1").select("sig", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("first_key"), "n_links"), "classes")
    alone = F.lit(0).cast("long") if count_links else F.lit(None).cast("long")
    # rows without words share no key, so that they don't meet in one task
    found = base.filter("sig IS NOT NULL").select("doc_id", "key", "sig").join(of, "sig", "left")
    none = F.col("first_key").isNull()
    found = found.select("doc_id", F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(none, alone).otherwise(F.col("n_links")).alias("n_links"), "key", F.coalesce("first_key", "key").alias("first_key"))
    wordless = base.filter("sig IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), alone.alias("n_links"), "key", F.col("key").alias("first_key"))
    return found.unionByName(wordless)


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their class.

    Of rows alike in id and text one stays: the least by the text of all its columns as JSON. An empty table stays empty.
    """
    found = stored(similar_documents(docs, threshold, n, count_links=False).select("key", "first_key"), "found")
    kept = without(docs, row_key(), stored(found.filter("key != first_key").select(F.col("key").alias("key__")).distinct(), "gone"))
    again = stored(found.groupBy(F.col("key").alias("key__")).agg(F.count("*").alias("n")).filter("n > 1").select("key__"), "again")
    if again.isEmpty():
        return kept
    # which of several rows alike stays: rows that occur once are not moved again
    once = without(kept, row_key(), again)
    row = kept.select(F.struct("*").alias("row__"), row_key().alias("key__")).join(again, "key__", "left_semi")
    row = row.groupBy("key__").agg(F.min_by("row__", F.to_json("row__")).alias("row__")).select(*[F.col(f"row__.`{c}`") for c in kept.columns])
    return once.unionByName(row)


#: The join by brute force in DuckDB SQL, over documents with ids of their own: every pair of different sets that shares a shingle.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct([array_to_string(w[i : i + least({SHINGLE}, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least({SHINGLE}, len(w)) + 2)])) AS sh FROM w WHERE len(w) > 0),
g AS (SELECT sh, min(doc_id) AS id, count(*) AS weight FROM s GROUP BY sh),
x AS (SELECT id, len(sh) AS n, unnest(sh) AS t FROM g),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE shared >= {THRESHOLD} * (na + nb - shared) - 1e-9 UNION ALL SELECT b, a FROM p WHERE shared >= {THRESHOLD} * (na + nb - shared) - 1e-9),
reach AS (SELECT id AS a, id AS b FROM g UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
classes AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT l.a AS id, sum(weight) AS n FROM l JOIN g ON g.id = l.b GROUP BY l.a),
looked AS (SELECT sh, class_id, weight - 1 + coalesce(n, 0) AS n_links FROM g JOIN classes USING (id) LEFT JOIN links USING (id))
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN looked ON looked.sh = s.sh
"""
