"""Language identification: n-gram classifiers predict the bits of error-correcting codewords; loss-weighted decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import gram_counts, unit_rows

#: Different rows of each language that the bit classifiers are fitted on: about so many, and never more than twice as many.
SAMPLE_PER_LANG = 1000
#: Languages that are learned, at most: those with the most rows, equal ones by name.
MAX_LANGS = 256
LOG2_DIMS = 11
GRAMS = (1, 2, 3)
RIDGE = 1.0
#: Up to so many languages, the code has every split of the languages in two; beyond, 10 * log2(languages) random splits.
EXHAUSTIVE = 6
#: A prediction is ambiguous if the two nearest codewords' weighted losses differ by less, as a share of the nearest's distance to the farthest.
AMBIGUOUS = 0.1
UNDETERMINED = "und"
BLOCK = 256

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The text's lower-case letters, with one space for whatever is between; "" if there is no letter."""
    return _NOT_LETTERS.sub(" ", text).strip().lower() if text else ""


def has_letter(spaced: str) -> bool:
    return any(map(str.isalpha, spaced))


def features(spaced: str) -> np.ndarray:
    return np.log1p(gram_counts(f" {spaced} ".encode("utf-8", "surrogatepass"), LOG2_DIMS, GRAMS))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A matrix of +1 and -1, languages x bits, in which no two rows are equal, and no two columns equal or opposite.

    Column by column the random split is taken, of several, that leaves the closest rows farthest apart.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        cols = [c for k in range(n - 1) for c in combinations(range(1, n), k)]  # language 0 is always +1, some other is -1
        return np.asarray([[1 if i == 0 or i in c else -1 for c in cols] for i in range(n)], dtype=float)
    rng, bits, seen = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), set()
    code, apart = np.empty((n, 0)), np.full((n, n), np.inf)
    apart[~np.eye(n, dtype=bool)] = 0
    while code.shape[1] < bits:
        best = None
        for _ in range(20):
            c = rng.choice([-1.0, 1.0], n)
            c *= c[0]
            if abs(c.sum()) == n or c.tobytes() in seen:
                continue
            now = apart + (c[:, None] != c[None, :])
            low = now.min()
            rank = (low, -(now == low).sum())
            if best is None or rank > best[0]:
                best = rank, c, now
        if best:
            seen.add(best[1].tobytes())
            code, apart = np.hstack([code, best[1][:, None]]), best[2]
    return code


@dataclass
class EcocModel:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # feature dimensions + 1 x bits
    trust: np.ndarray  # languages x bits: how well a bit is predicted on that language, rows summing to 1

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest language, score, margin). Loss of a bit: log(1 + exp(-2 * codeword bit * output))."""
        out = np.hstack([unit_rows(x), np.ones((len(x), 1))]) @ self.weights
        loss = np.stack([(np.logaddexp(0, -2 * out * c) * t).sum(1) for c, t in zip(self.code, self.trust, strict=True)], axis=1)
        best = loss.argmin(1)
        p = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        two = np.sort(loss, axis=1)
        margin = (two[:, 1] - two[:, 0]) / np.maximum(two[:, -1] - two[:, 0], 1e-12) if loss.shape[1] > 1 else np.ones(len(x))
        return best, 1 / p.sum(1), margin


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge regressions of the codewords' bits on unit vectors x (with a constant), in which every language weighs the same."""
    per = np.bincount(y, minlength=len(code)).astype(float)
    w = (len(y) / (np.count_nonzero(per) * per[y]))[:, None]
    return np.linalg.solve(x.T @ (x * w) + ridge * np.eye(x.shape[1]), x.T @ (code[y] * w))


def fit_model(langs: list[str], x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> EcocModel:
    """The model of feature vectors x of languages number y; how far a bit is trusted comes from halves that it was not fitted on."""
    x, code = np.hstack([unit_rows(x.astype(np.float32)).astype(np.float64), np.ones((len(x), 1))]), codewords(len(langs))
    order = np.argsort(y, kind="stable")
    half = np.empty(len(y), dtype=int)
    half[order] = np.arange(len(y)) % 2  # every language is halved, but for an odd row
    right = np.zeros((len(y), code.shape[1]))
    for k in (0, 1):
        test, train = half == k, half != k
        if train.any():
            right[test] = np.sign(x[test] @ fit_bits(x[train], y[train], code, ridge)) == code[y[test]]
    # a language seen once or never right still trusts all its bits alike
    trust = np.stack([right[y == k].mean(0) for k in range(len(langs))]) + 1e-6
    return EcocModel(langs, code, fit_bits(x, y, code, ridge), trust / trust.sum(1, keepdims=True))


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, ridge: float = RIDGE, max_langs: int = MAX_LANGS) -> EcocModel:
    """Fit on docs (doc_id, text, lang): of each language about per_lang different rows, by a hash of id and text against a share of its count.

    Repeated rows count once in the sample. The counts of at most max_langs languages and the sample's vectors, at most
    2 * per_lang a language, reach the driver; texts don't.
    """
    hashed = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang").withColumn("h", F.xxhash64("doc_id", "text"))
    counted = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different"))
    counts = {r.lang: r.different for r in counted.orderBy(F.col("n").desc(), "lang").limit(max_langs).collect()}
    if not counts:
        return EcocModel([], np.zeros((0, 1)), np.zeros(((1 << LOG2_DIMS) + 1, 1)), np.zeros((0, 1)))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in counts.items()], "lang string, share double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spaced = [letters(t) for t in b["text"].to_pylist()]
            x = [features(s).astype(np.float16).tobytes() if has_letter(s) else None for s in spaced]
            yield pa.RecordBatch.from_arrays([b["lang"], b["h"], pa.array(x, pa.binary())], names=["lang", "h", "x"])

    picked = hashed.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    once = picked.groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = once.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).filter(F.col("k") <= 2 * per_lang)
    got = sorted((r.lang, r.h, bytes(r.x)) for r in few.select("lang", "h", "text").mapInArrow(run, "lang string, h long, x binary").collect() if r.x is not None)
    langs = sorted({k for k, _, _ in got})
    if not langs:
        return fit(docs.limit(0))
    number = {k: i for i, k in enumerate(langs)}
    return fit_model(langs, np.stack([np.frombuffer(v, dtype=np.float16) for _, _, v in got]), np.asarray([number[k] for k, _, _ in got]), ridge)


def predict(docs: DataFrame, model: EcocModel, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), margin and ambiguous of every document row, from its whole text.

    lang_pred is "und" with score 0 where the text is null or has no letter, or where there was no language to learn.
    Equal losses go to the language that sorts first. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64(), "margin": pa.float64(), "ambiguous": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b["text"].to_pylist()
            lang, score, margin = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            for at in range(0, len(texts), BLOCK):
                spaced = [letters(t) for t in texts[at : at + BLOCK]]
                known = [k for k, s in enumerate(spaced) if m.langs and has_letter(s)]
                if known:
                    best, p, gap = m.decode(np.stack([features(spaced[k]) for k in known]))
                    for k, i, q, g in zip(known, best.tolist(), p.tolist(), gap.tolist(), strict=True):
                        lang[at + k], score[at + k], margin[at + k] = m.langs[i], q, g
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lang, pa.string()), pa.array(score), pa.array(margin), pa.array(margin < ambiguous)], names=list(types))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, ambiguous boolean")
