"""Spelling variants against every pair of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docweave.llm import queries, spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, typos=None, shortest=7, least=2) -> Counter:
    n: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if typos and h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= shortest
    return Counter({w: c for w, c in n.items() if c >= least})


def brute(n: Counter) -> set:
    form, number = {}, {}
    for w, c in n.items():
        others = [v for v in n if abs(len(v) - len(w)) <= 1 and near(w, v)]
        number[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * c else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), c, number[w], n.get(form[w])) for w, c in n.items()}


def found(words) -> list[tuple]:
    return [tuple(r) for r in spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def variants_of(word: str) -> list[str]:
    return [word, word[1:], word[:-1], word + "s", "é" + word, word[:3] + "ÿ" + word[4:], word[:2] + word[3:], word[:5] + word[4:]]


WORDS = [("between", 4000), ("colours", 900), ("ÀÉîîîôu", 50), ("aaaaaaaaaa", 700), ("strengthen", 30), ("unrelated", 3)]
ROWS = [
    (i, " ".join(v + (" " + v) * (n // (1 + 60 * j * j)) for j, v in enumerate(variants_of(w))))
    for i, (w, n) in enumerate(WORDS)
] + [
    (90, None), (91, ""), (92, "x" * 70_000 + " " + "x" * 70_000 + " " + "x" * 69_999 + "y," + "x" * 69_999 + "y"), (None, "BETWEEN Between betwEEn"),
    (93, "chainaaa " * 5000 + "chainaab " * 400 + "chainabb " * 30 + "chainbbb " * 2), (93, "tieingaa tieingaa tieingab tieingab tieingac tieingac"),
    (93, "tieingaa tieingaa"), (94, "short words only here 123 ÷×÷×÷×÷× ÷×÷×÷×÷×"),
]


@pytest.mark.parametrize("typos", [None, 3])
def test_brute_force(spark, typos):
    rows = [r for r in ROWS if r[0] != 92]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = spelling.vocabulary(docs, typos=typos)
    n = brute_counts(rows, typos)
    assert {(r.word, r.n) for r in words.collect()} == set(n.items())
    got = found(words)
    assert len(got) == len(n) and set(got) == brute(n)
    assert {r[2] for r in got if r[0] == "chainbbb"} == {"chainaaa"} or typos


def test_slices_change_nothing(spark):
    """A filter that does not fit one broadcast goes in several."""
    docs = spark.createDataFrame([r for r in ROWS if r[0] != 92], "doc_id long, text string")
    words = spelling.vocabulary(docs)
    pairs = spelling.near_words(words).collect()
    assert sorted(pairs) == sorted(spelling.near_words(words, most=48).collect()) and len(set(pairs)) == len(pairs)


def test_very_long_words(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] == 92], "doc_id long, text string")
    got = {r[0][-1] + str(len(r[0])): r[3:5] for r in found(spelling.vocabulary(docs))}
    assert got == {"x70000": (2, 1), "y70000": (2, 1)}


def test_nulls_clashes_and_empty_tables(docs, none, rows):
    n = brute_counts(rows)
    assert set(found(spelling.vocabulary(docs))) == brute(n)
    assert found(spelling.vocabulary(none)) == []


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = brute_counts(rows, 31)
    got = queries.QUERIES["op13_spelling_variants"](spark, sf)
    assert got.where(F.col("form").isNotNull()).count() >= 5
    assert {(r.word, r.n) for r in got.collect()} == set(n.items())
    some = {w for w in n if zlib.crc32(w.encode()) % 5 == 0}
    near_some = {(w, sum(near(w, v) for v in n if abs(len(v) - len(w)) <= 1)) for w in some}
    assert {(r.word, r.n_near) for r in got.collect() if r.word in some} == near_some
