"""Secret scan, decontamination, language ID and language model against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.llm import decontamination, language, language_model, queries, secrets

LOWER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def test_base_spans_follow_the_rules(rows):
    for _, text in rows:
        text = text or ""
        want = []
        rule = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        want += [(m.start(), 0, m.end()) for m in re.finditer(rule, text, re.I | re.A) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert secrets.base_spans(text) == sorted(want)


def test_automata_learn_formats():
    rng = __import__("random").Random(2)
    values = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(300)]
    ordinary = ["".join(rng.choice(["tion", "er", "an", "the", "lich"]) for _ in range(4)) for _ in range(600)]
    model = secrets.learn({"access": values, "other": ordinary})
    assert len(model["tables"][0][0]) < 60  # merged, not a tree of 4,800 states
    passes = lambda v: secrets.ratios(model, v)[0] > model["thresholds"][0]
    held_out = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(50)]
    assert all(map(passes, held_out)) and not any(map(passes, ordinary))


def test_tree_likelihoods_equal_counted_shares():
    """Before merging: the product over a value's characters of the shares counted after each prefix."""
    rng = random.Random(3)
    values = ["".join(rng.choice("ab1") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["a" * 3000, "a" * 3000 + "b"]
    floor = 0.01
    table = secrets.Automaton(values).table(floor)

    def share(k, n):
        return math.log2((1 - floor) * k / n + floor / secrets.ALPHABET)

    for v in {*values, "aab", "b1"}:
        want, known = 0.0, 0
        for i, c in enumerate(v):
            n = sum(x.startswith(v[:i]) for x in values)
            k = sum(x.startswith(v[: i + 1]) for x in values)
            want += share(k, n) if k else math.log2(floor / secrets.ALPHABET)
            known = i + 1 if k and known == i else known
            if not k:
                break
        if known == len(v):
            want += share(values.count(v), sum(x.startswith(v) for x in values))
            assert secrets.log_likelihood(table, v) == pytest.approx(want)


def test_merging_keeps_counts_and_long_values_end():
    """Arrivals of every reachable state are its ends and moves; no part of a long value is cut."""
    rng = random.Random(4)
    values = ["sk-" + "".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in [20] * 40 + [500, 700, 5000]]
    tree = secrets.Automaton(values)
    assert sum(tree.ended) == len(values)
    merged = tree.merged()
    todo, seen = [0], {0}
    while todo:
        s = todo.pop()
        assert merged.arrived[s] == merged.ended[s] + sum(n for _, n in merged.moves[s].values())
        for to, _ in merged.moves[s].values():
            if to not in seen:
                seen.add(to)
                todo.append(to)
    assert sum(merged.ended[s] for s in seen) == len(values)


def test_secret_scan_keeps_base_spans_and_redacts(docs, rows, none):
    got = secrets.with_secrets(docs, "found").select("doc_id", "text", "found").collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["found"] if s["kind"] in secrets.KINDS]
        assert base == secrets.base_spans(r["text"] or "")
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert clean[15]["text"] == 'key [secret]" [secret] ok' and clean[4]["text"] is None
    assert secrets.redact(docs).columns == docs.columns and secrets.with_secrets(none, "found").count() == 0


def test_unlabelled_credentials_among_other_runs_are_found(spark):
    rng = __import__("random").Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    usual = lambda: "".join(rng.choice(["tion", "er", "an", "the", "lich"]) for _ in range(5))
    texts = [f"{usual()} token={hexes(40)} {usual()}" for _ in range(60)] + [f"{usual()} {usual()}" for _ in range(300)]
    hidden = [hexes(15) + "-" + hexes(15) for _ in range(6)]
    texts += [f"{usual()} {v} {usual()}" for v in hidden] + [f"{usual()} {'ab' * 150}{'Z' * 50} {usual()}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in secrets.with_secrets(docs).collect()}
    like = {i: [r.text[s["start"] : s["end"]] for s in r.secrets if s["kind"].startswith("like_")] for i, r in got.items()}
    assert [like[360 + i] for i in range(6)] == [[v] for v in hidden]
    assert not any(like[i] for i in range(360))


def brute_contamination(text, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, names = find(text), set(), set()
    for name, item in items:
        v = find(item)
        n = min(window, len(v))
        for k in range(len(v) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("limit", [1, 1 << 24])  # every item in a block of its own, and all in one
def test_contamination_equals_brute_force(spark, docs, rows, none, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEM_BYTES", limit)
    long = dict(rows)[10].split()
    items = [(1, " ".join(long[5:30])), (2, "ONE, two"), (3, None), (4, "  "), (5, "absent words only here"),
             (6, " ".join(long[20:40])), (6, " ".join(long[100:112])), (12, "two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, benchmark).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == Counter(
        (i, n, h, tuple(s)) for i, t in rows
        for n, h, s in [brute_contamination(t, items)]
    )
    m = {(x["item_id"], x["item_start"], x["doc_start"], x["length"]) for r in got if r["doc_id"] == 10 for x in r["matches"]}
    assert ("1", 0, 5, 25) in m and ("6", 0, 20, 20) in m
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.where("doc_id in (7, 8, 10)").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert decontamination.contamination(none, benchmark).count() == 0
    assert decontamination.contamination(docs, benchmark.where("false")).where("n_hit > 0").count() == 0


def test_language_is_learned_and_held_out(spark, docs, rows, none):
    found = queries.QUERIES["op4_language_id"](spark, SF).join(queries.table(spark, SF, "documents"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    model = language.train(queries.table(spark, SF, "documents"))
    got = {r["doc_id"]: r for r in language.predict(docs.drop("score"), model).collect()}
    for i in (4, 5, 6, 13):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[9]["lang_pred"] in ("en", "fr", "de", "es") and 0 <= got[9]["score"] <= 1
    assert language.predict(none, model).count() == 0
    empty = language.predict(docs, language.train(none)).select("lang_pred").distinct().collect()
    assert [r[0] for r in empty] == ["und"]


def kneser_ney(train):
    c = Counter(w for x in train for w in x)
    pairs = Counter(p for x in train for p in zip(["<s>", *x[:-1]], x))
    d2 = language_model.discounts([sum(v == i for v in pairs.values()) for i in (1, 2, 3, 4)])
    after = Counter(b for _, b in pairs)
    d1 = language_model.discounts([sum(v == i for v in after.values()) for i in (1, 2, 3, 4)])
    uniform = sum(d1[min(v, 3)] for v in after.values()) / (len(c) + 1)
    left, total = defaultdict(float), Counter()
    for (a, _), k in pairs.items():
        left[a] += d2[min(k, 3)]
        total[a] += k
    low = lambda w: (after[w] - d1[min(after[w], 3)] + uniform) / sum(after.values())
    return c, lambda a, b: ((pairs[a, b] - d2[min(pairs[a, b], 3)] + left[a] * low(b)) / total[a]) if total[a] else low(b)


def test_language_model_equals_brute_force(docs, rows, none):
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"]
    train = [(i, t) for i, t in rows if zlib.crc32(str(i if i is not None else "").encode()) % 5 != 1]
    c, p = kneser_ney([split(t) for _, t in train])
    fold = language.fold("doc_id", 5)
    model = language_model.train(docs.where(fold != 1))
    got = sorted(
        (r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))
        for r in language_model.score(docs.select("doc_id", "text"), model).collect()
    )
    n = sum(c.values())
    want = []
    for i, t in rows:
        x = split(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in x)
        score = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *x[:-1]], x))
        want.append((i or -1, len(x), sum(c[w] > 0 for w in x), round(base, 6), round(score, 6)))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    for g, w in zip(got, sorted(want), strict=True):
        assert g[3:] == pytest.approx(w[3:], rel=1e-9, abs=1e-5)
    assert abs(sum(p("ta", w) for w in c) + p("ta", "unknown") - 1) < 1e-9
    nothing = language_model.score(docs.select("doc_id", "text"), language_model.train(none)).collect()
    assert {r["score"] for r in nothing} == {0.0} and {r["n_known"] for r in nothing} == {0}
