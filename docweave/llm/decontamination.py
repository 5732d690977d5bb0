"""Benchmark decontamination with suffix arrays over the training texts.

Each task builds suffix arrays over shards (blocks of texts): the suffixes that begin with
the first words of some test window, ordered by their first ``window`` words (no other suffix
can begin an occurrence).  Every suffix of the test items is then looked up by binary search;
its range holds all places where the window occurs, and consecutive hits on a diagonal are
one verbatim match.  Nothing is shuffled: a document's hits lie in its own task.

The items are the query set.  They come in blocks of at most ``ITEM_BYTES`` of text (or one
longer item), each broadcast on its own, so the broadcast doesn't grow with the benchmark.

Null or wordless text has no words and is never hit.  Null item ids are listed as ``null``.
A window that an item repeats is located at its first place there.  Repeated documents are answered
each, items of one id together.  A text longer than a block is a block of its own.  An empty table of
documents gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.columns import free_name, scan
from docweave.llm.words import ALNUM, ROOT, U64, blocks, counts_within, expand, mix, ngrams, offsets, text_bytes, word_hashes

ITEM_BYTES = 16 << 20
MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())])
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
EMPTY = pa.array([], pa.struct([("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("matches", pa.list_(MATCH))]))
FOUND = "struct<n_words: long, spans: array<struct<start: long, end: long>>, matches: array<struct<item_id: string, item_start: long, doc_start: long, length: long>>>"


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The items with words in blocks of bounded size, streamed from Spark."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text")
    for r in rows.where("text is not null").toLocalIterator():
        if held and size + len(r.text) * 4 > ITEM_BYTES:
            yield held
            held, size = [], 0
        held.append((r.i, r.text))
        size += len(r.text) * 4
    yield held


def windows_of(items: list[tuple[str, str]], window: int) -> dict | None:
    """Distinct windows of a block as rows of word hashes, and the item places of each."""
    at, data = text_bytes(pa.array([t for _, t in items], pa.string()))
    words, counts = word_hashes(at, data, ALNUM)
    start = offsets(counts)
    has = np.flatnonzero(counts)
    if not len(has):
        return None
    size = np.minimum(counts[has], window)
    number = counts[has] - size + 1
    place = expand(start[:-1][has], number)
    item, size = np.repeat(has, number), np.repeat(size, number)
    rows = np.zeros((len(place), window + 1), U64)
    rows[:, 0] = size
    for k in range(window):
        long = size > k
        rows[long, k + 1] = words[place[long] + k]
    key = np.ascontiguousarray(rows).view(f"V{8 * (window + 1)}").ravel()
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    order = np.lexsort((place, item, group))
    g, i, p = group[order], item[order], place[order] - start[item[order]]
    once = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]
    lead = int(min(4, size.min()))
    rows = rows[first]
    begin = rows[:, 1].copy()  # as ngrams() has it
    for k in range(1, lead):
        begin = mix(begin * U64(ROOT) + rows[:, k + 1])
    return {
        "window": window,
        "lead": lead,
        "size": rows[:, 0].astype(np.int64),
        "words": rows[:, 1:],
        "begin": begin,
        "item_at": offsets(np.bincount(g[once], minlength=len(rows))),
        "item": i[once],
        "item_place": p[once],
        "names": np.array([n for n, _ in items], object),
    }


def _bisect(column: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each value in its own sorted range of the column."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        v = column[np.where(open_, mid, 0)]
        up = open_ & ((v <= value) if right else (v < value))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def occurrences(test: dict, words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window number, word place) of every occurrence in a shard."""
    lead, depth = test["lead"], test["window"]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = ngrams(words, lead)
    if not len(grams):
        return none
    near = test["bloom"][(grams >> U64(44)).astype(np.int64)]
    suffix = np.flatnonzero(near)
    begins = test["begins"]
    p = np.minimum(np.searchsorted(begins, grams[suffix]), len(begins) - 1)
    suffix = suffix[begins[p] == grams[suffix]]
    row_end = start[np.searchsorted(start, suffix, side="right")]
    inside = suffix + lead <= row_end
    suffix, row_end = suffix[inside], row_end[inside]
    if not len(suffix):
        return none
    columns = []
    for k in range(depth):
        ok = suffix + k < row_end
        columns.append(np.where(ok, words[np.minimum(suffix + k, len(words) - 1)], U64(0)))
    order = np.lexsort(columns[::-1])
    suffix, row_end, columns = suffix[order], row_end[order], [c[order] for c in columns]
    tests = np.flatnonzero(np.isin(test["begin"], grams[suffix]))
    lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), len(suffix), np.int64)
    for k in range(depth):
        live = np.flatnonzero((test["size"][tests] > k) & (lo < hi))
        if not len(live):
            break
        v = test["words"][tests[live], k]
        a = _bisect(columns[k], v, lo[live], hi[live], False)
        hi[live] = _bisect(columns[k], v, a, hi[live], True)
        lo[live] = a
    which = np.repeat(tests, hi - lo)
    at = expand(lo, hi - lo)
    fits = suffix[at] + test["size"][which] <= row_end[at]
    return which[fits], suffix[at][fits]


def _runs(hit: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of hit words; none crosses a text."""
    m = np.r_[False, hit, False]
    edge = np.zeros(len(hit) + 1, bool)
    edge[start[:-1]] = True
    edge[len(hit)] = True
    return np.flatnonzero(m[1:-1] & (~m[:-2] | edge[:-1])), np.flatnonzero(m[1:-1] & (~m[2:] | edge[1:])) + 1


def scan_block(test: dict, at: np.ndarray, data: np.ndarray) -> pa.StructArray:
    words, counts = word_hashes(at, data, ALNUM)
    start, n = offsets(counts), len(counts)
    if test is None:
        none = pa.array([[]] * n, pa.list_(SPAN))
        return pa.StructArray.from_arrays(
            [pa.array(counts.astype(np.int64)), none, pa.array([[]] * n, pa.list_(MATCH))], fields=list(EMPTY.type)
        )
    which, place = occurrences(test, words, start)
    size = test["size"][which]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + size, -1)
    a, b = _runs(np.cumsum(change[:-1]) > 0, start)
    base = start[np.searchsorted(start, a, side="right") - 1] if len(a) else a
    spans = pa.ListArray.from_arrays(
        pa.array(offsets(counts_within(a, start)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(b - base, pa.int64())], fields=list(SPAN)),
    )
    # Every hit of every item, then hits that follow one another on a diagonal as one match.
    number = np.diff(test["item_at"])[which]
    k = expand(test["item_at"][:-1][which], number)
    item, there = test["item"][k], test["item_place"][k]
    here, size = np.repeat(place, number), np.repeat(size, number)
    doc = np.searchsorted(start, here, side="right") - 1
    order = np.lexsort((here, here - there, item, doc))
    doc, item, there, here, size = doc[order], item[order], there[order], here[order], size[order]
    new = np.ones(len(here), bool)
    if len(here):
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (here[1:] - there[1:] != here[:-1] - there[:-1]) | (here[1:] != here[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(here)][: len(first)].astype(np.int64) - 1
    matches = pa.ListArray.from_arrays(
        pa.array(offsets(np.bincount(doc[first], minlength=n)), pa.int32()),
        pa.StructArray.from_arrays(
            [
                pa.array(test["names"][item[first]], pa.string()),
                pa.array(there[first], pa.int64()),
                pa.array(here[first] - start[doc[first]], pa.int64()),
                pa.array(here[last] + size[last] - here[first], pa.int64()),
            ],
            fields=list(MATCH),
        ),
    )
    return pa.StructArray.from_arrays([pa.array(counts.astype(np.int64)), spans, matches], fields=list(EMPTY.type))


def prepared(test: dict) -> dict:
    begins = np.unique(test["begin"])
    bloom = np.zeros(1 << 20, bool)
    bloom[(begins >> U64(44)).astype(np.int64)] = True
    return test | {"begins": begins, "bloom": bloom}


def _scan(shared, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    test = prepared(shared.value) if shared is not None else None
    for column in columns:
        at, data = text_bytes(column)
        parts = [scan_block(test, at[i : j + 1] - at[i], data[at[i] : at[j]]) for i, j in blocks(at)]
        yield pa.concat_arrays([EMPTY, *parts])


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, into: str = "_contamination") -> DataFrame:
    """Add a struct: ``n_words``; ``n_hit`` words inside windows; ``matches``, the verbatim matches
    of at least a window with item, places and length; ``items``, their item ids as sorted text."""
    spark = docs.sparkSession
    found, names = docs, []
    for items in item_blocks(benchmark):
        if (test := windows_of(items, window)) is not None:
            names.append(free_name(found.columns, f"{into}_{len(names)}"))
            found = found.withColumn(names[-1], scan(_scan, FOUND, spark.sparkContext.broadcast(test))("text"))
    if not names:  # no item has a word
        names = [free_name(found.columns, f"{into}_0")]
        found = found.withColumn(names[0], scan(_scan, FOUND, None)("text"))
    spans = F.array_sort(F.flatten(F.array(*(f"{n}.spans" for n in names))))
    n_hit = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["e"], x["start"]))).alias("n"),
            F.greatest(s["e"], x["end"]).alias("e"),
        ),
        lambda s: s["n"],
    )
    matches = F.flatten(F.array(*(f"{n}.matches" for n in names)))
    items = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))
    result = F.struct(
        F.col(f"{names[0]}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        matches.alias("matches"),
        items.alias("items"),
    )
    return found.withColumn(into, result).drop(*names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Only the documents that no window of the benchmark occurs in; columns unchanged."""
    c = free_name(docs.columns, "_contamination")
    return with_matches(docs, benchmark, window, c).where(f"{c}.n_hit = 0").drop(c)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted text), matches, contaminated."""
    c = with_matches(docs.select("doc_id", "text"), benchmark, window)
    return c.select(
        "doc_id",
        "_contamination.n_words",
        "_contamination.n_hit",
        F.size("_contamination.items").cast("long").alias("n_items"),
        "_contamination.items",
        "_contamination.matches",
        (F.col("_contamination.n_hit") > 0).alias("contaminated"),
    )
