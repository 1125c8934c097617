"""op5_line_dedup: recurring lines are told by the number of different documents alone."""

from __future__ import annotations

import random

from palisade.llm import line_templates

from .test_operators import words

SCHEMA = "doc_id long, text string"


def dropped(spark, texts: list[str]) -> dict[int, str]:
    rows = list(enumerate(texts))
    return {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_common_line_with_few_neighbours(spark):
    rng = random.Random(21)
    # 40 documents, but only 4 different lines stand beside the recurring one; each text is different
    around = [words(rng, 9) for _ in range(4)]
    texts = ["\n".join([words(rng, 9), around[i % 4], "Les.", around[i % 4], words(rng, 9)]) for i in range(40)]
    got = dropped(spark, texts + [texts[0]] * 60)
    assert all("Les." not in t for t in got.values())


def test_copies_count_once(spark):
    rng = random.Random(22)
    text = "\n".join(words(rng, 9) for _ in range(5))
    other = words(rng, 9) + "\n" + text.split("\n")[2]
    got = dropped(spark, [text] * 20 + [other])
    assert got[0] == text and got[20] == other  # two different documents only


def test_near_copies_keep_their_lines(spark):
    rng = random.Random(23)
    lines = [words(rng, 9) for _ in range(12)]
    # 30 texts, each with another line of the same document edited
    texts = ["\n".join(words(rng, 9) if p == i % 12 else x for p, x in enumerate(lines)) for i in range(30)]
    got = dropped(spark, texts)
    assert [got[i] for i in range(30)] == texts


def test_blank_lines_blocks_and_headers(spark):
    rng = random.Random(24)
    own = lambda n=9: words(rng, n)
    blank, a, b, c, h1, h2 = (words(rng, 5) for _ in range(6))
    texts = ["\n\n".join([own(), blank, own()]) for _ in range(20)]
    texts += ["\n".join([own(), a, b, c, own()]) for _ in range(20)]
    texts += ["\n".join([h1, h2, own(), own()]) for _ in range(20)]
    got = dropped(spark, texts)
    assert not {blank, a, b, c, h1, h2} & {x for t in got.values() for x in t.split("\n")}
