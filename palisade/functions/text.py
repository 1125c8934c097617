"""Text operators as native columns: folding, entropy, tokens, shingles; and minimum hashes, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters that are deleted (zero-width, bidirectional controls, soft hyphen; then the Tag block).
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\ufeff\u2060\u00ad\u180e\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
TAG_BLOCK = (0xE0000, 0xE007F)

# Look-alike letters and the Latin ones they stand for.
LOOKALIKES = {
    "Cyrillic small": ("аеорсхуіԁһɡᴏбткмнвѕј", "aeopcxyidhgobtkmhbsj"),
    "Cyrillic capital": ("АВЕКМНРСТХЅІЈОБГЗ", "ABEKMHPCTXSIJObr3"),
    "Greek small": ("οαειρυνχ", "oaeipuvx"),
    "Greek capital": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    "Armenian": ("ոռօ", "nno"),
    "fullwidth": ("ａｅｉｏ", "aeio"),
}
LOOKALIKE_FROM = "".join(a for a, _ in LOOKALIKES.values())
LOOKALIKE_TO = "".join(b for _, b in LOOKALIKES.values())

# Common English words that tell recovered language from noise.
COMMON_WORDS = (
    "the a an and or but if then to of in on at by for with from as is are was were be been being do does did you your "
    "i we they it he she this that these those not no yes can will would should could ignore previous instruction "
    "instructions system prompt now please tell show me my all any"
).split()

# A provenance token and the characters stripped from its end.
TOKEN = "[a-z0-9][a-z0-9._@+/-]{2,}"
TOKEN_TAIL = "._-/+@"

_A, _Z = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, f"[{INVISIBLE}\\x{{{TAG_BLOCK[0]:X}}}-\\x{{{TAG_BLOCK[1]:X}}}]", "")


def map_lookalikes(text: Column) -> Column:
    return F.translate(text, LOOKALIKE_FROM, LOOKALIKE_TO)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold_native(text: Column) -> Column:
    """The folded surface form but for compatibility normalization, which Spark has no function for (see views.fold)."""
    return collapse_whitespace(map_lookalikes(strip_invisible(text)))


def split_glued(text: Column) -> Column:
    """A space where a word is glued to what precedes it: small letter or digit to capital, acronym to word, digit to letter."""
    return F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])", " ")


def rot13(text: Column) -> Column:
    return F.translate(text, _A, _Z)


def word_score(text: Column) -> Column:
    """How many words of a text are common English ones."""
    return F.size(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0), lambda w: w.isin(COMMON_WORDS)))


def if_recovered(text: Column, changed: Column) -> Column:
    """changed, where it has more common words than text; else null."""
    return F.when((changed != text) & (word_score(changed) > word_score(text)), changed)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: a lambda's variable is never spliced into its body as an expression is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text. Counts come from one pass over the sorted characters."""

    def runs(chars: Column) -> Column:
        start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0.0).alias("s"))
        # s gathers n * log2(n) of finished runs: the entropy is log2(total) - s / total
        done = lambda a: a["s"] + F.when(a["n"] > 0, a["n"] * F.log2(a["n"].cast("double"))).otherwise(0.0)
        step = lambda a, c: F.struct(c.alias("c"), F.when(a["c"] == c, a["n"] + 1).otherwise(1).alias("n"), F.when(a["c"] == c, a["s"]).otherwise(done(a)).alias("s"))
        total = F.size(chars).cast("double")
        return F.log2(total) - F.aggregate(chars, start, step, done) / total

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(let(F.array_sort(F.split(text, "")), runs))


def entropy_windows(text: Column, width: int = 64, step: int = 32) -> Column:
    """The largest entropy of the windows of a text; that of the whole text if it is shorter than a window."""
    starts = F.sequence(F.lit(0), F.length(text) - width, F.lit(step))
    return F.when(F.length(text) < width, entropy(text)).otherwise(F.array_max(F.transform(starts, lambda i: entropy(F.substring(text, i + 1, F.lit(width))))))


def tokens(text: Column) -> Column:
    """Provenance tokens: lower-case, without trailing separators, of at least three characters, each once."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    cut = F.transform(raw, lambda t: F.regexp_replace(t, r"[._\-/+@]+$", ""))
    return F.array_distinct(F.filter(cut, lambda t: F.length(t) >= 3))


def token_digests(text: Column, most: int | None = None) -> Column:
    """The first 16 hex digits of SHA-256 of each provenance token, in the order of first occurrence; with most, no more than that."""
    digests = F.transform(tokens(text), lambda t: F.substring(F.sha2(t, 256), 1, 16))
    return digests if most is None else F.slice(digests, 1, most)


def is_ingested(value: Column, result_digests: Column, input_digests: Column) -> Column:
    """Whether a value has a token that came from a tool result of the turn and not from the user's text."""
    return F.size(F.array_except(F.array_intersect(token_digests(value), result_digests), input_digests)) > 0


def word_bigrams(text: Column) -> Column:
    """Distinct word pairs "a b" of a text; a single word is paired with "", no word gives none."""

    def pairs(words: Column) -> Column:
        many = F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))
        none = F.array().cast("array<string>")
        return F.when(F.size(words) == 0, none).when(F.size(words) == 1, F.array(F.concat(F.get(words, F.lit(0)), F.lit(" ")))).otherwise(many)

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), 0), pairs)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays as sets; empty says what two empty ones have (0 for bigrams, 1 for call fingerprints)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_pairs(text: Column) -> Column:
    """Distinct character pairs of a text, in order of first occurrence; none below two characters."""
    # from the split text, as a substring's place is counted from the text's start each time
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(let(F.split(text, ""), lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b)))))


def char_bigrams(text: Column) -> Column:
    """Distinct character pairs of a lower-cased text."""
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(char_pairs(F.lower(text)))


#: Items whose hashes a Python worker keeps, 256 bytes each; character pairs recur from text to text.
HASHED_ITEMS = 100_000


def minhash(items: Column, size: int = 64) -> Column:
    """size minima, over the items, of the first eight hex digits of md5("seed:item"); empty without items, nulls for null.

    In Arrow batches, as an item's hashes are then computed once for many rows and not anew in each.
    """

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        low = _Minima(size)
        for s in batches:
            yield s.map(low.of, na_action="ignore")

    return F.coalesce(run(items), F.array_repeat(F.lit(None).cast("bigint"), size))


class _Minima:
    """Minimum hashes of lists of items; the hashes of up to HASHED_ITEMS items are kept."""

    def __init__(self, size: int):
        self.seeds = [hashlib.md5(str(s).encode(), usedforsecurity=False) for s in range(size)]
        self.place: dict[str | None, int] = {}
        self.rows = np.empty((1024, size), np.uint32)

    def hashes(self, item: str | None) -> bytes:
        """The first four bytes of each seed's digest; of the seed alone for null."""
        raw, out = b"" if item is None else b":" + item.encode(), []
        for h in self.seeds:
            h = h.copy()
            h.update(raw)
            out.append(h.digest()[:4])
        return b"".join(out)

    def _place(self, item: str | None) -> int:
        n = len(self.place)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[n] = np.frombuffer(self.hashes(item), ">u4")
        self.place[item] = n
        return n

    def of(self, items) -> np.ndarray:
        least = np.full(len(self.seeds) if len(items) else 0, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(items), 4096):
            if len(self.place) >= HASHED_ITEMS:
                self.place.clear()
            known = self.place.get
            at = [self._place(x) if (p := known(x)) is None else p for x in items[i : i + 4096]]
            np.minimum(least, self.rows[at].min(axis=0), out=least)
        return least.astype(np.int64)


def minhash_likeness(a: Column, b: Column) -> Column:
    """The share of equal minima; 0 if a side has none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same / F.greatest(F.size(a), F.size(b)))


def redact_url(url: Column) -> Column:
    """scheme://host[:port]/path without user info, query and fragment; unchanged without a scheme."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/@]*@", "$1")
