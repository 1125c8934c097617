"""The ten operators against brute force, round trips, held-out labels and awkward inputs."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.llm import chosen_path, common, langid_ecoc, license_rules, line_templates, lz_fingerprint, packing, phrase_index, quality_knn, queries, url_rules, warc_segments

from ..conftest import SF

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# columns that the operators use inside, as extra columns of the input
CLASH = ["key", "key__", "row__", "places", "templates", "run", "halo", "g", "sig", "bucket", "class_id", "n_links", "score", "predicted", "n_lines", "best", "x"]


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def awkward(spark, extra: bool = True):
    rng = random.Random(1)
    base = words(rng, 120)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "   "), (6, "!!! ???"), (7, words(rng, 30_000)), (None, words(rng, 50)), (None, None), (8, "one"), (9, base.replace("a", "b", 1)), (10, "日本語 テキスト\n\n\tx"), (11, "a\x00b <|endoftext|> c"), (-4, words(rng, 40))]
    d = spark.createDataFrame([(i, t, "en" if i != 3 else None, None, None) for i, t in rows], DOC)
    return d.withColumns({c: F.lit("clash") for c in CLASH}) if extra else d


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


# 1 --------------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    got = queries.op1_quality_classifier(spark, SF).join(common.table(spark, SF, "labels"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_quality_cosines_are_exact():
    rng = np.random.default_rng(0)
    x, y = rng.random((60, quality_knn.DIMS)).astype(np.float32), rng.integers(0, 2, 60).astype(float)
    u = common.unit_rows(x)
    centre = u.mean(0)
    basis = np.linalg.svd(u - centre, full_matrices=False)[2][:8].T
    m = quality_knn.KnnModel(centre, basis, common.unit_rows((u - centre) @ basis), y, float(y.mean()), 5)
    for q in rng.random((7, quality_knn.DIMS)).astype(np.float32):
        v = (q / np.linalg.norm(q) - centre) @ basis
        cos = np.array([v @ w / np.linalg.norm(v) / np.linalg.norm(w) for w in m.vectors])
        near = np.argsort(-cos)[:5]
        w = np.maximum(cos[near], 1e-6) ** quality_knn.SHARPNESS
        assert m.score(q[None])[0] == pytest.approx((w * y[near]).sum() / w.sum(), abs=1e-4)


def test_latent_basis():
    rng = np.random.default_rng(2)
    x = (rng.random((80, 3)) @ rng.random((3, 50)) * 5 + 0.01 * rng.random((80, 50))).astype(np.float32)
    b, exact = quality_knn.latent_basis(x, 3), np.linalg.svd(x, full_matrices=False)[2][:3].T
    assert np.abs(b @ b.T - exact @ exact.T).max() < 0.01
    assert quality_knn.latent_basis(x[:2], 48).shape == (50, 2)


def test_quality_fit_against_brute_force(spark):
    """The fitted sample is what its definition says, and the basis spans the exact first singular vectors."""
    rng = random.Random(8)
    rows = [(i, words(rng, 20 + i) + ("!!" if i % 2 else "")) for i in range(60)] + [(3, "another text")] * 50 + [(61, None), (62, "")]
    labels = [(i, i % 2) for i in range(63)]
    m = quality_knn.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), per_class=20, rank=5)
    h = {r.i: r.h for r in spark.range(63).select(F.col("id").alias("i"), F.xxhash64("id").alias("h")).collect()}
    texts = dict(rows[:60])
    picked = [i for y in (0, 1) for i in sorted((i for i, q in labels if q == y), key=lambda i: h[i])[:20] if i < 60]
    assert len(m.labels) == len(picked) and m.labels.sum() == sum(i % 2 for i in picked)
    if 3 not in picked:
        x = common.unit_rows(np.stack([quality_knn.features(texts[i]).astype(np.float16).astype(np.float32) for i in sorted(picked)]))
        assert np.abs(m.centre - x.mean(0)).max() < 1e-4
        top = np.linalg.svd(x - x.mean(0), full_matrices=False)
        kept = np.linalg.norm((x - x.mean(0)) @ m.basis) ** 2
        assert kept == pytest.approx((top[1][:5] ** 2).sum(), rel=0.02)


def test_quality_awkward(spark):
    d = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 1, 0), (99, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_knn.fit(d, labels)
    assert quality_knn.classify(d, model).count() == d.count()
    kept = quality_knn.filter_quality(d, labels)
    assert kept.columns == d.columns and kept.count() <= d.count()
    none = quality_knn.fit(d.limit(0), labels.limit(0))
    assert {r.score for r in quality_knn.classify(d, none).collect()} == {0.5}
    assert quality_knn.classify(d.limit(0), model).count() == 0


# 2 --------------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    got = queries.op2_language_id(spark, SF).join(common.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 8, 9, 20, 100])
def test_codewords(n):
    code = langid_ecoc.codewords(n)
    assert len({tuple(r) for r in code}) == n
    if n > 1:
        assert len({tuple(c * c[0]) for c in code.T}) == code.shape[1]  # no two columns equal or opposite
        assert all(abs(c.sum()) < n for c in code.T)
    if 2 < n <= langid_ecoc.EXHAUSTIVE:
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) == 2 ** (n - 2)  # so 2 ** (n - 3) - 1 wrong bits are corrected at least


def test_language_decoding_against_brute_force():
    """Bits, trust, losses and the ambiguity margin, computed one by one from the definition."""
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 7):
        y = rng.integers(0, k, 60)
        y[:k] = range(k)
        x = (rng.random((60, 1 << langid_ecoc.LOG2_DIMS)) < 0.02) + 2.0 * (np.arange(1 << langid_ecoc.LOG2_DIMS)[None, :] % 11 == y[:, None])
        m = langid_ecoc.fit_model([f"l{i}" for i in range(k)], x, y)
        code, u = langid_ecoc.codewords(k), np.hstack([common.unit_rows(x.astype(np.float32)).astype(float), np.ones((60, 1))])
        per = Counter(y.tolist())
        for b in range(code.shape[1]):  # the ridge regression's gradient is zero
            w = np.asarray([60 / (k * per[i]) for i in y])
            gradient = u.T @ (w * (u @ m.weights[:, b] - code[y, b])) + langid_ecoc.RIDGE * m.weights[:, b]
            assert np.abs(gradient).max() < 1e-6
        assert np.allclose(m.trust.sum(1), 1) and (m.trust > 0).all()
        q = x[:9] + rng.random((9, x.shape[1])) * 0.1
        best, score, margin = m.decode(q)
        for r in range(9):
            v = np.append(q[r] / np.linalg.norm(q[r]), 1.0)
            out = [float(v @ m.weights[:, b]) for b in range(code.shape[1])]
            loss = [sum(m.trust[i, b] * np.log1p(np.exp(-2 * code[i, b] * out[b])) for b in range(code.shape[1])) for i in range(k)]
            order = sorted(range(k), key=lambda i: (loss[i], i))
            assert best[r] == order[0]
            assert score[r] == pytest.approx(1 / sum(np.exp(-8 * (x_ - min(loss))) for x_ in loss), rel=1e-5)
            want = (loss[order[1]] - loss[order[0]]) / max(max(loss) - min(loss), 1e-12) if k > 1 else 1.0
            assert margin[r] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_language_ties_go_to_the_first():
    m = langid_ecoc.EcocModel(["a", "b", "c"], np.ones((3, 2)), np.ones(((1 << langid_ecoc.LOG2_DIMS) + 1, 2)), np.full((3, 2), 0.5))
    best, score, margin = m.decode(np.eye(1, 1 << langid_ecoc.LOG2_DIMS))
    assert best[0] == 0 and score[0] == pytest.approx(1 / 3) and margin[0] < langid_ecoc.AMBIGUOUS


def test_language_sample_is_bounded(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 8), "en") for i in range(300)] + [(900, words(rng, 8), "fr")] * 400 + [(901 + i, "x y", f"junk{i}") for i in range(30)]
    m = langid_ecoc.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=20, max_langs=2)
    assert m.langs == ["en", "fr"]


def test_language_awkward(spark):
    d = awkward(spark)
    model = langid_ecoc.fit(d)
    got = langid_ecoc.predict(d, model).collect()
    assert len(got) == d.count()
    by = {r.doc_id: r for r in got}
    for i in (3, 4, 5, 6):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert by[10].lang_pred == "en"  # letters of any script
    assert {r.lang_pred for r in langid_ecoc.predict(d, langid_ecoc.fit(d.limit(0))).collect()} == {"und"}


# 3 --------------------------------------------------------------------------------------------------------------------


def brute_links(texts: list[str | None], threshold: float = 0.8) -> list[set[int]]:
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    out: list[set[int]] = [set() for _ in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                out[i].add(j)
                out[j].add(i)
    return out


def brute_classes(links: list[set[int]]) -> list[int]:
    low = list(range(len(links)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(links):
            m = min([low[i], *(low[j] for j in js)])
            if m < low[i]:
                low[i], changed = m, True
    return low


def near_copies(rng: random.Random, text: str, n: int, edits: int) -> list[str]:
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = words(rng, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [chosen_path.SMALL, 8])
def test_join_against_brute_force(spark, monkeypatch, small):
    """Also with so small buckets and blocks that splits and block pairs are needed."""
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "VERIFY_BLOCK", small)
    rng = random.Random(4)
    texts = []
    for k in range(12):
        t = words(rng, 150)
        texts += [t, t, *near_copies(rng, t, 3, 1 + k % 4)]
    texts += near_copies(rng, words(rng, 200), 40, 2)
    shared = words(rng, 60)
    texts += [words(rng, 40) + " " + shared for _ in range(25)]
    texts += [words(rng, n) for n in range(1, 9)] + ["x", "x", None, "", "?"]
    rng.shuffle(texts)
    got = {r.doc_id: r for r in chosen_path.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    links = brute_links(texts)
    low = brute_classes(links)
    assert [got[i].class_id for i in range(len(texts))] == low
    assert [got[i].n_links for i in range(len(texts))] == [len(x) for x in links]


def test_join_awkward(spark):
    d = awkward(spark)
    got = chosen_path.similar_documents(d).collect()
    assert len(got) == d.count()
    assert {r.class_id for r in got if r.doc_id in (1, 2, 9)} == {1}
    assert {r.n_links for r in got if r.doc_id in (1, 2, 9)} == {3}
    kept = chosen_path.keep_one_of_each(d)
    assert kept.columns == d.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[9] and ids[None] == 2 and ids[3] == ids[4] == 1
    twice = chosen_path.keep_one_of_each(d.filter("doc_id = 2")).collect()
    assert [r.doc_id for r in twice] == [2]
    assert chosen_path.similar_documents(d.limit(0)).count() == 0


@pytest.mark.parametrize("small", [chosen_path.SMALL, 2])
def test_recall_at_the_threshold(spark, monkeypatch, small):
    """Pairs of similarity 0.8 exactly (40 of 50 shingles), through the whole operator; with buckets of 2 all are split to the end."""
    monkeypatch.setattr(chosen_path, "SMALL", small)
    rng = random.Random(13)
    texts = []
    for _ in range(300):
        w = words(rng, 49).split()
        texts.append(" ".join(w))
        w[24] = "zzzzzzzz"
        texts.append(" ".join(w))
    assert brute_links(texts[:2]) == [{1}, {0}]
    for count in (True, False):
        got = {r.doc_id: r for r in chosen_path.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), count_links=count).collect()}
        found = sum(got[2 * i + 1].class_id == 2 * i for i in range(300))
        assert found >= chosen_path.RECALL * 300 - 3
        assert not any(got[2 * i].class_id != 2 * i for i in range(300))


def test_classes_of_a_large_group_in_blocks(spark, monkeypatch):
    """Chains of near copies, cut into small blocks: classes without all pairs are those with all pairs."""
    monkeypatch.setattr(chosen_path, "VERIFY_BLOCK", 6)
    rng = random.Random(17)
    texts = []
    for _ in range(3):
        chain = words(rng, 120).split()
        for k in range(25):  # each is like the one before it, and less and less like the first
            texts.append(" ".join(chain))
            chain[(k * 11) % 120] = words(rng, 1)
    texts += near_copies(rng, words(rng, 120), 40, 1)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in chosen_path.similar_documents(d, count_links=False).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(brute_links(texts))


def test_which_of_equal_rows_stays(spark):
    d = spark.createDataFrame([(1, "one two three", "b"), (1, "one two three", "a"), (1, "one two three", "c")], "doc_id long, text string, source string")
    assert [r.source for r in chosen_path.keep_one_of_each(d).collect()] == ["a"]


def test_runs_reach_recall():
    rng = random.Random(8)
    found = 0
    for _ in range(200):
        a = words(rng, 104)
        w = a.split()
        w[50] = "zzzzzzzz"
        x, y = chosen_path.shingles(a), chosen_path.shingles(" ".join(w))
        runs = chosen_path.runs_for(chosen_path.RECALL)
        found += bool(set(chosen_path.paths(x, runs)[0].tolist()) & set(chosen_path.paths(y, runs)[0].tolist()))
    assert found >= 198


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    links: list[set[int]] = [set() for _ in range(13)]
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    d = spark.createDataFrame(edges, "a int, b int") if edges else spark.createDataFrame([], "a int, b int")
    got = {r.node: r.root for r in common.components(d).collect()}
    low = brute_classes(links)
    assert got == {i: low[i] for i, js in enumerate(links) if js - {i}}


# 4 --------------------------------------------------------------------------------------------------------------------


def check_packing(pieces, texts: list[tuple], capacity: int = 1024) -> tuple[int, int]:
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = Counter()
    for i, t in texts:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        docs[(i, len(ids), ids.tobytes())] += 1
    got: dict = {}
    for r in pieces:
        got.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (i, n, raw), copies in docs.items():
        ids, mine = np.frombuffer(raw, dtype="<u4"), got[(i, n)]
        crcs = Counter((r.start, r.length, r.ids_crc32) for r in mine)
        assert sum(r.length for r in mine) == copies * n
        for (start, length, crc), _ in crcs.items():
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
        starts = Counter(r.start for r in mine)
        assert starts[0] == copies
    used = padding = 0
    seqs: dict = {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append(r)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        used += at
        padding += capacity - at if at & (at - 1) else 0
    return used, padding


def test_packing(spark):
    d = common.table(spark, SF, "documents")
    used, padding = check_packing(packing.pack(d, group_docs=50).collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert padding <= 0.001 * used


def test_packing_awkward(spark):
    d = awkward(spark)
    check_packing(packing.pack(d).collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert packing.pack(d.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "one text"), (None, None)], "doc_id long, text string").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500))))
    rows = packing.one_by_one(same.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert sorted(r.copy for r in rows.filter("doc_id = 1").collect()) == list(range(1, 501)) and rows.count() == 1000
    pieces = packing.pack(same, group_docs=100).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in same.collect()])
    assert len({r.sequence_id >> 32 for r in pieces}) == 10  # spread over all groups


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=40))
def test_first_fit_decreasing(lengths):
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b in bins:
            if sum(lengths[j] for j in b) + lengths[i] <= 32:
                b.append(i)
                break
        else:
            bins.append([i])
    assert packing.first_fit_decreasing(lengths, 32) == bins
    seqs = packing.fill(lengths, 32)
    assert Counter((i, p) for s in seqs for i, at, n in s for p in range(at, at + n)) == Counter((i, p) for i, n in enumerate(lengths) for p in range(n))
    assert all(t == 32 or t & (t - 1) == 0 for t in (sum(n for _, _, n in s) for s in seqs))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r'.,!sS1é \x85\x1c"), st.characters(max_codepoint=0x300, exclude_categories=["Cs"])), max_size=60))
def test_tokens_are_the_tokenizers(text):
    import public_tokenizers as P

    bpe = packing_bpe()
    assert bpe.ids(text).tolist() == bpe.whole.encode(text, add_special_tokens=False).ids
    assert P


_BPE: list = []


def packing_bpe():
    if not _BPE:
        import public_tokenizers as P

        _BPE.append(packing.ByteBpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    return _BPE[0]


# 5 --------------------------------------------------------------------------------------------------------------------


def brute_lines(texts: list[tuple]) -> dict:
    """(id, text) -> places of lines to drop, by the definition."""
    L = line_templates

    def masked(line: str) -> str:
        if re.search(r"[\d@\t\r\f]|://|  ", line):
            line = re.sub(r"(?a)\s+", " ", re.sub(r"(?a)(?<!\S)(?:[^\s\d]*\d\S*|https?://\S*|[^\s@]+@\S+)", "<*>", line))
        return line.strip(" ")

    docs = {doc: [masked(x) for x in (doc[1] or "").split("\n")] for doc in set(texts)}
    leaf = lambda m: (len(m.split(" ")), *m.split(" ")[: -(-L.LEADING * len(m.split(" ")) // 10)])
    leaves: dict = {}
    for ms in docs.values():
        for m in filter(None, ms):
            leaves.setdefault(leaf(m), set()).add(m)
    template = {}
    for ms in leaves.values():
        count = Counter((p, t) for m in ms for p, t in enumerate(m.split(" ")))
        for m in ms:
            n = [count[p, t] for p, t in enumerate(m.split(" "))]
            least = sorted(n, reverse=True)[-(-L.STAYING * len(n) // 10) - 1]
            template[m] = tuple(t if k >= least else None for k, t in zip(n, m.split(" "), strict=True))
    copy = {doc: tuple(filter(None, ms)) for doc, ms in docs.items()}
    of: dict = {}
    for doc, ms in docs.items():
        for m in filter(None, ms):
            of.setdefault(template[m], set()).add(copy[doc])
    recurring = {t for t, copies in of.items() if len(copies) >= L.MIN_DOCS}
    share = {}
    for doc, ms in docs.items():
        sizes = [len(m) for m in ms if m and template[m] in recurring]
        share[copy[doc]] = sum(sizes) / sum(map(len, ms)) if len(sizes) >= L.COPIED_LINES else 0.0
    out: dict = {}
    for doc, ms in docs.items():
        for p, m in enumerate(ms):
            if m and template[m] in recurring:
                apart = [share[c] for c in of[template[m]] if share[c] < L.NEAR_COPY]
                everywhere = sum(x < L.OWN for x in apart) >= L.MIN_DOCS
                if len(apart) >= L.MIN_DOCS and (everywhere or share[copy[doc]] < L.NEAR_COPY):
                    out.setdefault(doc, set()).add(p)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    passage, foot = words(rng, 60), [words(rng, n) for n in (5, 1, 8)]
    copied = "\n".join(words(rng, 8) for _ in range(6))
    near = [words(rng, 10) for _ in range(8)]
    few = "ab cd ef".split()
    for i in range(60):
        lines = [words(rng, 9) for _ in range(rng.randrange(1, 6) if i < 40 else 25)]
        lines += [" ".join(rng.choice(few) for _ in range(4)) for _ in range(i % 3)]  # lines that share tokens by chance
        if i % 2:
            lines.insert(rng.randrange(len(lines) + 1), f"Page {i} of 40, printed 2024-01-{i:02d} by x{i}@example.org")
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        if i % 4 == 0:
            lines.append(f"this article was written by {words(rng, 1)}")
        if i % 5 == 0:
            lines += ["", "  "]
        rows.append((i, "\n".join(lines + foot)))
    for i in range(12):
        rows.append((300 + i, "\n".join(words(rng, 10) if p == i % 8 else x for p, x in enumerate(near))))
    rows += [(100 + i, copied) for i in range(10)] + [(110, copied.replace("\n", "\n\n")), (200, None), (201, ""), (3, rows[3][1])]
    got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_lines(rows)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id]
        gone = want.get((r.doc_id, t), set())
        assert r.n_dropped == len(gone)
        assert r.text == (t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone))
    by = {r.doc_id: r for r in got}
    for i in range(60):
        t = by[i].text.split("\n")
        assert not {passage, *foot} & set(t) and "Page" not in by[i].text and "this article was" not in by[i].text
    assert all(by[100 + i].text == copied for i in range(10))  # copies are left to the near-duplicate step


def test_line_dedup_awkward(spark):
    d = awkward(spark)
    out = line_templates.drop_recurring_lines(d)
    assert out.count() == d.count()
    assert set(out.columns) == {*d.columns, "n_dropped"}
    assert line_templates.drop_recurring_lines(d.limit(0)).count() == 0
    same = line_templates.drop_recurring_lines(d, counts=False)
    assert same.schema == d.schema and {r.n_lines for r in same.collect()} == {"clash"}


# 6 and 7 --------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    notice = "\n\n".join(t for i, t in license_rules.SENTENCES if i in ("mit.grant", "mit.notice"))
    rows = [(1, "Hi. Released under the MIT License. Bye"), (2, notice), (3, "MIT is a school."), (4, None), (5, ""), (6, "SPDX-License-Identifier: Apache-2.0\nAll rights reserved."), (7, "released UNDER the mit license")]
    got = {r.doc_id: r for r in license_rules.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(1, 8)] == ["MIT", "MIT", "", "", "", "Apache-2.0", "MIT"]
    assert got[2].rule_hits == 1 and got[2].n_sentences == 2
    assert license_rules.scan_licenses(awkward(spark)).count() == awkward(spark).count()
    assert license_rules.scan_licenses(awkward(spark).limit(0)).count() == 0
    rows = [(1, "word " * 400_000 + "\nReleased under the MIT License.\n" + "word. " * 100_000), (2, "All rights reserved."), (3, "Copyright X. All rights reserved.\n\n" + "\n".join(t for i, t in license_rules.SENTENCES if i.startswith("bsd.")))]
    got = {r.doc_id: r for r in license_rules.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in (1, 2, 3)] == ["MIT", "Proprietary", "BSD-3-Clause"]
    assert got[3].rule_hits == 1 and got[3].n_sentences == 5


def test_every_license_is_known_by_its_names(spark):
    lines = license_rules.known_lines()
    got = license_rules.scan_licenses(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(lines)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {k: i.removeprefix("line:") for k, (i, _) in enumerate(lines)}
    known = [license_rules.normal(t) for _, t in license_rules.default_sentences()]
    assert all(any(w in k for w in license_rules.needed_words(known)) for k in known)


def test_url_rules(spark):
    cases = [
        ("http://A.Example.COM/en/x?y", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"),
        ("https://x.net/en", "x.net", "/en", None, "allow"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("https://b.com", "b.com", "", None, "allow"),
        ("https://b.com#/en/", "b.com", "", None, "allow"),
        ("b.com/x", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("x://y://z.net/es/", "y:", "//z.net/es/", None, "allow"),
        ("http://com/", "com", "/", "com/", "allow"),
    ]
    d = spark.createDataFrame([(i, c[0], "c", "c") for i, c in enumerate(cases)], "page_id long, url string, rule string, best string")
    got = url_rules.judge_urls(d, url_rules.rule_table(spark, url_rules.RULES)).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in got] == cases
    assert {r.verdict for r in url_rules.judge_urls(d, url_rules.rule_table(spark, []), "block").collect()} == {"block"}
    assert url_rules.judge_urls(d.limit(0), url_rules.rule_table(spark, url_rules.RULES)).count() == 0
    every = url_rules.judge_urls(d, url_rules.rule_table(spark, url_rules.RULES), max_shapes=1).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in every] == cases  # too many shapes: all prefixes


def test_url_ties_and_long_urls(spark):
    rules = [("allow", "x.org", "/a"), ("block", "x.org", "/a"), ("allow", "org", "/abcd"), ("block", "b.x.org", "/")]
    urls = ["http://x.org/abc", "http://b.x.org/abc", "http://x.org/" + "a" * 100_000, "http://x.org/abc"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_rules.judge_urls(d, url_rules.rule_table(spark, rules)).orderBy("page_id").collect()
    # of one rule with both verdicts block counts; of equally long ones the one with the longer host
    assert [(r.rule, r.verdict) for r in got] == [("x.org/a", "block"), ("b.x.org/", "block"), ("x.org/a", "block"), ("x.org/a", "block")]


# 8 --------------------------------------------------------------------------------------------------------------------


def brute_contamination(texts, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, t in texts:
        w, hit, which = find(t), set(), set()
        for item, x in items:
            v = find(x)
            n = min(10, len(v))
            for a in range(len(v) - n + 1) if v else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[a : a + n]:
                        hit |= set(range(s, s + n))
                        which.add(str(item))
        out.append((i, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_chars", [phrase_index.BLOCK_CHARS, 300])
def test_contamination_against_brute_force(spark, block_chars):
    rng = random.Random(2)
    small = lambda n: " ".join(rng.choice("aa bb cc dd É7 x").strip() or "aa" for _ in range(n))
    items = [(i, words(rng, 25)) for i in range(6)] + [(6, "short item"), (7, "solo"), (8, None), (9, "..."), (10, small(12)), (3, words(rng, 12))]
    texts = [(i, words(rng, 60)) for i in range(10)]
    for k, (i, t) in enumerate(items[:6]):
        w = t.split()
        texts.append((50 + i, words(rng, 20) + " " + " ".join(w[k : k + 12]).upper() + ", " + words(rng, 9)))
    texts += [(70, "a Short, item! solo"), (71, None), (72, ""), (73, small(40)), (74, items[10][1] + " " + items[10][1]), (70, "a Short, item! solo")]
    got = phrase_index.find_contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars)
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(brute_contamination(texts, items))


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [(1, item.replace("gamma", "gamma new")), (2, item), (3, "alpha iota"), (4, " x ".join(item.split()) + " y" * 30)]
    got = phrase_index.find_contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].items == ["5"] and by[2].near_items == []
    assert by[1].items == [] and by[1].near_items == ["5"]
    assert by[3].near_items == []
    # whether a neighbour in the shard has the word that is missing doesn't matter
    alone = phrase_index.find_contamination(spark.createDataFrame([(1, item.replace("gamma", "delta"))], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert alone.first().near_items == ["5"]


def test_contamination_awkward(spark):
    d, b = awkward(spark), spark.createDataFrame([(1, "one"), (None, "x")], "item_id long, text string")
    assert phrase_index.find_contamination(d, b).count() == d.count()
    kept = phrase_index.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == d.count() - 1
    assert phrase_index.find_contamination(d, b.limit(0)).filter("contaminated").count() == 0
    assert phrase_index.find_contamination(d.limit(0), b).count() == 0


# 9 --------------------------------------------------------------------------------------------------------------------


def brute_phrases(data: bytes) -> set[bytes]:
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen | ({data[start:]} - {b""})


@settings(max_examples=200, deadline=None)
@given(st.text("abé ", max_size=80))
def test_phrases(text):
    data = text.encode()
    ends, *_ = lz_fingerprint.parse(data, {}, 0, 0)
    cut = [0, *ends] + ([len(data)] if (ends or [0])[-1] < len(data) else [])
    got = {data[a:b] for a, b in zip(cut, cut[1:], strict=False)}
    assert got == brute_phrases(data)
    assert len(set(lz_fingerprint.phrase_hashes(data, 0, ends, True).tolist())) == len(got)


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=60), st.integers(0, 60), st.text("abé", max_size=20))
def test_edit_shares_its_start(text, kept, tail):
    kept = min(kept, len(text))
    a, b = lz_fingerprint.with_edit(text, kept, tail)
    assert (a == lz_fingerprint.fingerprint(text)).all()
    assert (b == lz_fingerprint.fingerprint(text[:kept] + tail)).all()


@pytest.mark.parametrize("run_docs", [1, 7, 1024])
def test_fingerprints_against_brute_force(spark, run_docs):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(0, 60)) + rng.choice(["", "é", "日本"])) for i in rng.sample(range(-50, 1000), 40)] + [(2000, None), (2001, "")]
    got = {r.doc_id: r for r in lz_fingerprint.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), run_docs).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        a, b, c = (lz_fingerprint.fingerprint(x) for x in (t, edited, nxt))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lz_fingerprint.to_text(a), lz_fingerprint.to_text(b))
        assert (r.near_edited, r.near_next) == (lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c))


def test_fingerprints_awkward(spark):
    d = awkward(spark)
    assert lz_fingerprint.fingerprint_edits(d).count() == d.count()
    assert lz_fingerprint.fingerprint_edits(d.filter("doc_id = 8")).first().near_next == 1.0
    # a third of the rows with one id, a third with none
    rng = random.Random(5)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, words(rng, 12)) for i in range(90)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in lz_fingerprint.fingerprint_edits(many, 5).collect() if r.doc_id)
    assert got == sorted(tuple(r) for r in lz_fingerprint.fingerprint_edits(many, 1000).collect() if r.doc_id)
    hashed = many.withColumn("h", F.xxhash64("text"))
    cuts = lz_fingerprint.run_cuts(hashed, 18, 90, 30)
    sizes = [r["count"] for r in hashed.withColumn("run", lz_fingerprint._run_of(cuts)).groupBy("run").count().collect()]
    assert sum(sizes) == 90 and max(sizes) <= 20
    assert lz_fingerprint.fingerprint_edits(d.limit(0)).count() == 0


# 10 -------------------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 50))
def test_chunks(payload, size):
    assert warc_segments.from_chunks(warc_segments.to_chunks(payload, size)) == payload


@pytest.mark.parametrize("bad", [b"", b"5\r\nab", b"zz\r\n", b"2\r\nabc\r\n0\r\n\r\n", b"0\r\n"])
def test_bad_chunks(bad):
    with pytest.raises(warc_segments.WarcError):
        warc_segments.from_chunks(bad)


def test_warc_round_trip_in_segments(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}\r\nevil: 1", rng.choice(["a" * 5000, "b", None, "é" * rng.randrange(3000), words(rng, 400)])) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    n = warc_segments.write_archives(warc_segments.plan_revisits(pages), folder, segment_bytes=700, file_bytes=4000).collect()
    assert len(n) > 1
    files = spark.read.format("binaryFile").load(folder)
    got = {r.page_id: r for r in warc_segments.read_archives(files).collect()}
    first: dict = {}
    for i, _, html in rows:
        first.setdefault(html or "", i)
    for i, _, html in rows:
        data, r = (html or "").encode(), got[i]
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == i else ("revisit", first[html or ""]))
        if r.record_type == "response":
            assert bytes(r.payload) == data


def test_warc_missing_segment(spark, tmp_path):
    members = list(warc_segments.records("1", 1, "http://x", b"z" * 3000, None, segment_bytes=500))
    assert len(members) > 3
    for k, gone in enumerate((1, len(members) - 1)):
        data = b"".join(m for i, m in enumerate(members) if i != gone)
        d = spark.createDataFrame([(f"f{k}", bytearray(data))], "path string, content binary")
        with pytest.raises(Exception, match="segment|length"):
            warc_segments.read_archives(d).collect()
    with pytest.raises(warc_segments.WarcError):
        list(warc_segments.parse(members[0][:-9]))


def test_warc_pages_with_one_id(spark, tmp_path):
    """Rows that share a page_id but not a payload have records of their own, segments included."""
    rows = [(7, f"http://x/{k}", c * 3000) for k, c in enumerate("abc")] + [(8, "http://y", "a" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc_segments.write_archives(warc_segments.plan_revisits(pages), folder, segment_bytes=500).collect()
    files = spark.read.format("binaryFile").load(folder)
    ids = [f["warc-record-id"] for r in files.collect() for f, _ in warc_segments.parse(bytes(r.content))]
    assert len(set(ids)) == len(ids)
    got = [(r.page_id, r.record_type, bytes(r.payload or b"")[:1], r.refers_to) for r in warc_segments.read_archives(files).collect()]
    assert sorted(got) == [(7, "response", b"a", None), (7, "response", b"b", None), (7, "response", b"c", None), (8, "revisit", b"", 7)]


def test_warc_awkward(spark):
    rows = [(1, None, None), (2, "http://a", ""), (2, "http://a", ""), (None, "http://b", "x"), (None, None, None), (3, "http://c", "y" * 300_000), (4, "http://d", "y" * 300_000)]
    got = warc_segments.round_trip(spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, url string, html string, payload string, refers_to string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert by[1] == [("response", None)] and by[2] == [("revisit", 1)] * 2 and by[None] == [("response", None)] * 2
    assert by[3] == [("response", None)] and by[4] == [("revisit", 3)]
    assert warc_segments.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
