"""Jaccard join, nearest neighbours, chunks, packing and sharding against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import chunks, components, jaccard, leaves, neighbours, packing, sharding
from docweave.llm.words import text_bytes

LOWER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets, best = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                best[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return Counter((d, len(s), min(ids[root(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_join_equals_brute_force(docs, rows, none):
    got = jaccard.shingle_components(docs).collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == brute_components(rows)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.where("doc_id is not null").select("doc_id").collect()) == [1, 4, 5, 6, 7, *range(9, 19)]
    assert kept.where("doc_id is null").count() == 1
    assert jaccard.shingle_components(none).count() == 0 and jaccard.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("leaf", [leaves.LEAF, 20, 6])
def test_join_of_many_near_copies_loses_no_link(spark, monkeypatch, leaf):
    """Also where tiles must be dealt by a second shingle, and by a grid of cells."""
    monkeypatch.setattr(leaves, "LEAF", leaf)
    monkeypatch.setattr(leaves, "PIVOTS", min(leaves.PIVOTS, leaf // 8))
    monkeypatch.setattr(leaves, "STRAGGLERS", min(leaves.STRAGGLERS, leaf // 4))
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(4):
        base = rng.choice(vocabulary, 120).tolist()
        for _ in range(60):
            w = list(base)
            for k in rng.choice(120, rng.integers(0, 5), replace=False):
                w[k] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w[: 120 - rng.integers(0, 20)])))
    got = jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == brute_components(rows)


def test_sets_of_overlapping_groups_move_once(spark):
    """Groups whose union a task takes are one; larger ones stay, also with each other's sets."""
    groups = {(1, 0, 0): (1, 2, 3), (2, 0, 0): (2, 3, 4), (3, 0, 0): (1, 3, 4), (4, 0, 0): (10, 11), (4, 0, 1): (11, 12), (5, 1, 0): (10, 12), (6, 0, 0): (20, 21)}
    size = {k: leaves.BYTES // 16 if 10 <= k < 20 else 3 for g in groups.values() for k in g}
    members = spark.createDataFrame([(*g, min(of), k, k) for g, of in groups.items() for k in of], "key long, cell long, sub long, lo long, node long, c long")
    nodes = spark.createDataFrame(list(size.items()), "node long, n long")
    got = defaultdict(list)
    for r in leaves._merged(members, nodes).collect():
        got[r.key, r.cell, r.sub].append(r.node)
    large = [of for g, of in groups.items() if g[0] in (4, 5)]
    assert sorted(tuple(sorted(of)) for of in got.values()) == sorted([(1, 2, 3, 4), (20, 21), *large])


@pytest.mark.parametrize("bytes_", [leaves.BYTES, 20_000])
def test_merged_groups_lose_no_link(spark, monkeypatch, bytes_):
    monkeypatch.setattr(leaves, "OFTEN", 0)
    monkeypatch.setattr(leaves, "BYTES", bytes_)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(40):
            w = list(base)
            for k in rng.choice(150, rng.integers(0, 9), replace=False):
                w[k] = f"v{rng.integers(4000)}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == brute_components(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (7, 3), (3, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


@pytest.mark.parametrize("task", [components.TASK, 10])
def test_few_links_take_no_rounds_of_stars(spark, monkeypatch, task):
    rounds, star = [], components._large_star
    monkeypatch.setattr(components, "TASK", task)
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or star(edges))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(i, i + 20) for i in range(60, 80)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i + d: i for i in range(60, 80) for d in (0, 20)} and bool(rounds) == (task == 10)


def test_group_of_a_few_parts_meets_in_a_grid(spark, monkeypatch):
    """Its sets are not copied to groups by further keys."""
    for name, value in (("LEAF", 20), ("PIVOTS", 1), ("STRAGGLERS", 2)):
        monkeypatch.setattr(leaves, name, value)
    sets = [np.arange(100 * i, 100 * i + 10, dtype=np.uint64) for i in range(30)]
    sets[7] = np.r_[sets[3][:9], sets[7][:1]]
    nodes = spark.createDataFrame([(i, 10, bytearray(jaccard.bitmap(s)), i) for i, s in enumerate(sets)], "node long, n long, sketch binary, row_id long")
    whole = spark.createDataFrame([(i, i, 0, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, row_id long, piece int, shingles binary")
    first = spark.createDataFrame([(1, i) for i in range(30)], "key long, node long")

    def branch(members, level):
        raise AssertionError("dealt by further keys")

    found = leaves.linked(first, branch, 2, nodes, whole, 80, partial(jaccard.may_link, 80), grid=jaccard.GRID)
    assert sorted(tuple(r) for r in found.collect()) == [(3, 3), (7, 3)]


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(2))
        bound = jaccard.at_most(np.array([len(a), len(b)]), [jaccard.bitmap(a), jaccard.bitmap(b)])
        assert bound[0, 1] == bound[1, 0] >= len(np.intersect1d(a, b)) and bound[0, 0] == len(a)


def brute_nearest(rows, k: int) -> Counter:
    """(query, rank, id, score) from all pairs of vectors of a length."""
    v = [(i, np.array(x, np.float32).astype(float)) for i, x in rows]
    out = Counter()
    for a, (q, x) in enumerate(v):
        if q % 20 == 0:
            others = sorted((-float(x @ y), i) for b, (i, y) in enumerate(v) if b != a and len(y) == len(x))[:k]
            out.update((q, r + 1, i, round(-s, 4)) for r, (s, i) in enumerate(others))
    return out


def nearest_rows(found) -> Counter:
    return Counter((r.query_id, r.rank, r.vec_id, round(r.score, 4)) for r in found.collect())


def test_neighbours_are_exact_on_few_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(60, rows[0][1]), (61, rows[0][1]), (0, rows[0][1])]  # ties and a repeated row
    rows += [(i, rng.standard_normal(9).tolist()) for i in range(200, 205)] + [(400, [1.0])]  # other lengths
    bad = [(62, None), (80, [0.0] * 6), (64, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (65, [float("nan")] * 6), (None, [1.0] * 6), (100, [float("inf")] * 6)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("list", F.lit(1))
    assert nearest_rows(neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=7)) == brute_nearest(rows, 7)
    few = neighbours.nearest(table.where("vec_id in (20, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2
    assert neighbours.nearest(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_scan_abandons_and_finds(spark):
    """Lists of over 2,000 vectors, a third of them the same one: the tests abandon most candidates and recall holds."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((8, 48)) * 2
    rows = [(i, (centres[i % 8] + rng.standard_normal(48)).tolist()) for i in range(9000)]
    rows += [(i, rows[0][1]) for i in range(9000, 9300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = F.col("vec_id") % 20 == 0
    got = neighbours.nearest(table, asked, lists=4).collect()
    v = np.array([x for _, x in rows], np.float32).astype(float)
    queries = [i for i in range(len(v)) if i % 20 == 0]
    assert Counter(r.query_id for r in got) == {q: 20 for q in queries}
    found, hits = defaultdict(set), 0
    for r in got:
        assert r.score == pytest.approx(v[r.vec_id] @ v[r.query_id])
        found[r.query_id].add(r.vec_id)
    for q in queries:
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.lexsort((np.arange(len(v)), -score))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(queries)


def test_scan_looks_at_few_columns():
    """What a scan keeps, and that most candidates leave before their last block of columns."""
    rng = np.random.default_rng(10)
    x = np.r_[rng.standard_normal((20, 64)) * 0.3, rng.standard_normal((4000, 64)) * 2].astype(np.float32)
    q = np.zeros(64, np.float32)
    read = [0]

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple) and isinstance(at[1], slice):
                read[0] += len(at[0]) * (at[1].stop - at[1].start)
            return np.asarray(self)[at]

    places = neighbours.scan_cell(q, x.view(Counted), 20)
    assert set(np.argsort((x**2).sum(1))[:20]) <= set(places.tolist())
    assert read[0] < 0.5 * x.size


def test_neighbours_reach_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, v = zip(*[(r.vec_id, r.embedding) for r in table.collect()], strict=True)
    ids, v = np.array(ids), np.array(v)
    hit = total = 0
    for q, found in {q: g for q, g in neighbours.nearest(table, F.col("vec_id") % 20 == 0).toPandas().groupby("query_id")}.items():
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        hit += (found.score.to_numpy() >= np.sort(s)[-20] - 1e-9).sum()
        total += 20
    assert hit / total >= 0.9


def test_repeated_passages_go_and_clean_texts_stay(docs, rows, none):
    got = chunks.drop_repeats(docs)
    assert got.columns == [*docs.columns, "removed", "n_removed"]
    text = dict(rows)
    for r in got.collect():
        if r.doc_id is None:
            continue
        old = text[r.doc_id]
        kept, at = [], 0
        for s in r.removed:
            kept.append(old[at : s["start"]])
            at = s["end"]
        assert r.text == (None if old is None else "".join([*kept, old[at:]]))
        if r.doc_id in (1, 7, 8, 10, 15, 17, 18):
            assert r.n_removed == 0
    removed = {r.doc_id: r.n_removed for r in got.collect() if r.doc_id is not None}
    passage = len(text[12])
    assert removed[2] == len(text[2]) and removed[11] > 0.6 * passage and removed[12] > 0.6 * passage and removed[3] > 100
    assert chunks.drop_repeats(none).count() == 0


def brute_repeats(texts: list[bytes], size: int) -> list[set[int]]:
    """Bytes of each text in a window that occurred before (beyond its first place)."""
    seen, out = {}, []
    for t, raw in enumerate(texts):
        gone = set()
        for i in range(len(raw) - size + 1):
            u, j = seen.setdefault(raw[i : i + size], (t, i))
            if (u, j) != (t, i):
                gone.update(range(max(i, j + size) if u == t else i, i + size))
        out.append(gone)
    return out


@pytest.mark.parametrize("kinds", [1000, 2])
def test_every_repeated_window_goes(spark, monkeypatch, kinds):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(51) for _ in range(300)]
    short = [fresh(40)[:96] for _ in range(100)]  # exactly as long as the limit
    texts = [f"{fresh(20)} {p} {fresh(20)}" for _ in range(2) for p in [*passages, *short]]
    shared = [fresh(12) for _ in range(4)]
    # A seed whose first place goes on in another way, and passages put together from several places.
    texts += [f"{fresh(9)}{rng.choice(shared)}{rng.choice(shared)}{fresh(9)}{rng.choice(shared)}" for _ in range(40)]
    texts += ["x" * 5000, "-=" * 700 + fresh(30) + "-=" * 700, fresh(60) * 3, passages[0][:95]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_repeats([x.encode() for x in texts], 96)
    monkeypatch.setattr(chunks, "KINDS", kinds)
    got = {r.doc_id: r for r in chunks.drop_repeats(docs).collect()}
    for t, bytes_ in enumerate(want):
        assert {i for s in got[t].removed for i in range(s["start"], s["end"])} == bytes_, t
    assert all(got[400 + t].n_removed >= len(p) for t, p in enumerate([*passages, *short]))


def test_cuts_move_only_near_an_insertion():
    rng = np.random.default_rng(2)
    old = rng.integers(97, 123, 20_000).astype(np.uint8)
    new = np.r_[old[:5000], np.frombuffer(b"inserted", np.uint8), old[5000:]]
    ends = [set(chunks.cuts(np.array([0, len(x)]), x).tolist()) for x in (old, new)]
    moved = {e + 8 if e > 5000 else e for e in ends[0]} ^ ends[1]
    assert all(4900 < e < 6200 for e in moved) and len(ends[0]) > 300
    at, data = text_bytes(__import__("pyarrow").array(["é" * 3000]))
    assert all(e % 2 == 0 for e in chunks.cuts(at, data).tolist())


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_packing_is_an_exact_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            piece = np.array(ids[s : s + 2048], "<u4")
            want[i, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    got = packing.pack(docs, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_ids_equal_the_tokenizer():
    rng = np.random.default_rng(7)
    ids = packing.Ids(tokenizer_path())
    parts = ["a", "the", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "\x85", "\xa0", "\x1c", "ß", "A", "!!", "\r\n", "中", "<|endoftext|>", "ing", "œ"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_latin_texts_need_no_tokenizer():
    ids = packing.Ids(tokenizer_path())
    ids.encode("Les \xe9t\xe9s\nsont longs.")
    assert "tokenizer" not in vars(ids)


def test_fillings_use_every_piece_and_come_closest():
    rng = np.random.default_rng(8)
    for _ in range(30):
        histogram = {int(s): int(n) for s, n in zip(rng.integers(1, 65, 12), rng.integers(1, 9, 12), strict=True)}
        used = Counter()
        for times, counts in packing.fillings(histogram, 64):
            assert sum(s * k for s, k in counts.items()) <= 64
            for s, k in counts.items():
                used[s] += times * k
        assert used == Counter(histogram)
        counts, room = [histogram.get(s, 0) for s in range(65)], int(rng.integers(1, 65))
        sums = {0}
        for s, n in histogram.items():
            sums |= {x + s * k for x in sums for k in range(1, n + 1) if x + s * k <= room}
        assert sum(s * k for s, k in packing.fill(counts, room).items()) == max(sums)


def test_shards_are_even_gapless_and_reproducible(docs, rows, none):
    place = lambda d: sorted(map(tuple, sharding.shard_documents(d, 4).collect()), key=str)
    got = place(docs)
    assert got == place(docs.repartition(7, "text"))
    assert Counter((i, s, c) for i, s, c, _, _ in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = defaultdict(list)
    for *_, shard, slot in got:
        shards[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert sharding.shard_documents(none, 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4097])
def test_permutation_is_one_to_one(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 9)).collect()]
    assert sorted(got) == list(range(n)) and (n < 1000 or got != sorted(got))
