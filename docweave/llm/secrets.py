"""Secret scans by grammar inference.

Fixed rules find and label credentials.  From a bounded sample of the distinct labelled values
of each kind, a prefix tree is built and its statistically compatible states are merged
(Hoeffding test), which gives a probabilistic automaton per kind; another is learned the same
way from ordinary runs.  Every other run of credential characters is scored by the log
likelihood ratio per character of each kind against the ordinary one; runs above the kind's
threshold become spans ``like_<kind>``.  What the rules find always stays.

Other runs may hold credentials that no rule knows.  So there are two ordinary automata, from the
two halves of the sample by hash, and a run is scored by the one it is not in; and a threshold
comes from labelled values scored by automata they are not in, and from the quartiles of the
ratios of all distinct other runs, which no few runs can move.

Sample bound: ``EXAMPLES`` values per kind, ``ORDINARY`` times as many ordinary runs, those with
the smallest hash, ``LEARNED`` characters together; values are learned and runs scored whole.
Counts of spans, candidates and scores cover all texts.  Null and empty texts have no spans.  Texts may
be of any length.  Repeated rows are scanned each, and teach no more than one; values of equal hash go
by their text.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.columns import scan
from docweave.session import stage

#: The base rules, in the order of their kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # [0-9a-f]+ of 16 or more
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

EXAMPLES = 600
ORDINARY = 4  # times as many ordinary runs, which are more diverse
ALPHABET = 67
FLOOR = 1e-4  # share of probability spread over the alphabet
LEARNED = 1_000_000  # characters of a kind's examples together; each is learned whole
FENCE = 3  # quartile distances above the upper quartile of other runs
REMEMBERED = 50_000
SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the fixed rules find, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def other_runs(text: str, base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Runs of credential characters that touch no base span."""
    k, reach = 0, 0
    for m in RUN.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start():
            yield m


# --- automata ---------------------------------------------------------------------------


class Automaton:
    """States with counts of arrivals, ends and moves."""

    def __init__(self, values: list[str]):
        self.moves: list[dict[str, list[int]]] = [{}]  # character -> [state, count]
        self.arrived, self.ended = [0], [0]
        for value in values:
            s = 0
            self.arrived[0] += 1
            for c in value:
                if c not in self.moves[s]:
                    self.moves[s][c] = [len(self.moves), 0]
                    self.moves.append({})
                    self.arrived.append(0)
                    self.ended.append(0)
                self.moves[s][c][1] += 1
                s = self.moves[s][c][0]
                self.arrived[s] += 1
            self.ended[s] += 1

    def alike(self, a: int, b: int, bound: float) -> bool:
        """No end or move of the two states, or of states they lead to, differs beyond chance."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.arrived[a], self.arrived[b]
            if not n or not m:
                continue
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ended[a] / n - self.ended[b] / m) >= most:
                return False
            for c in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(c), self.moves[b].get(c)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) >= most:
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add state ``b``, the root of a tree, to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.arrived[a] += self.arrived[b]
            self.ended[a] += self.ended[b]
            for c, (to, n) in self.moves[b].items():
                if c in self.moves[a]:
                    self.moves[a][c][1] += n
                    todo.append((self.moves[a][c][0], to))
                else:
                    self.moves[a][c] = [to, n]

    def merged(self, alpha: float = 0.01) -> "Automaton":
        """Merge from the root outward: a state joins the first settled state it is like."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        settled, inside = [0], {0}
        border = deque((0, c) for c in sorted(self.moves[0]))
        while border:
            parent, c = border.popleft()
            s = self.moves[parent][c][0]
            if s in inside:
                continue
            for r in settled:
                if self.alike(r, s, bound):
                    self.moves[parent][c][0] = r
                    self.fold(r, s)
                    # what was folded in may have given settled states new moves
                    border.extend((q, d) for q in settled for d in sorted(self.moves[q]) if self.moves[q][d][0] not in inside and (q, d) not in border)
                    break
            else:
                settled.append(s)
                inside.add(s)
                border.extend((s, d) for d in sorted(self.moves[s]))
        return self

    def table(self, floor: float = FLOOR) -> tuple[list[dict[str, tuple[int, float]]], list[float], float]:
        """Reachable states only: moves with log2 probabilities, and log2 probability to end."""
        number, todo = {0: 0}, [0]
        while todo:
            for to, _ in self.moves[todo.pop()].values():
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
        moves, ends = [], []
        for s in number:
            n = max(self.arrived[s], 1)
            moves.append(
                {c: (number[to], math.log2((1 - floor) * k / n + floor / ALPHABET)) for c, (to, k) in self.moves[s].items()}
            )
            ends.append(math.log2((1 - floor) * self.ended[s] / n + floor / ALPHABET))
        return moves, ends, math.log2(floor / ALPHABET)


def log_likelihood(table, value: str) -> float:
    moves, ends, miss = table
    s, total = 0, 0.0
    for c in value:
        move = moves[s].get(c)
        if move is None:
            total += miss
        else:
            s = move[0]
            total += move[1]
    return total + ends[s]


def half(value: str) -> int:
    return zlib.crc32(value.encode()) & 1


def ratios(model: dict, value: str) -> list[float]:
    """Log2 likelihood ratio per character of each kind against ordinary runs of the other half."""
    usual = log_likelihood(model["ordinary"][1 - half(value)], value)
    return [(log_likelihood(t, value) - usual) / (len(value) + 1) for t in model["tables"]]


def learn(values: dict[str, list[str]]) -> dict:
    """Automata, and thresholds from labelled values; a kind with under 5 values learns nothing."""
    kinds = [k for k in KINDS if len(values.get(k, ())) >= 5]
    other: list[list[str]] = [[], []]
    for v in values.get("other", []):
        other[half(v)].append(v)
    model = {"kinds": kinds, "ordinary": [Automaton(o).merged().table(0.1) for o in other], "thresholds": []}
    model["tables"] = [Automaton(values[k]).merged().table() for k in kinds]
    for k in kinds:
        own = []
        for i in (0, 1):
            rest = model | {"tables": [Automaton(values[k][1 - i :: 2]).merged().table()]}
            own += [ratios(rest, v)[0] for v in values[k][i::2]]
        model["thresholds"].append(max(min(0.35 * float(np.median(own)), float(np.quantile(own, 0.05))), 0.5))
    return model


def above_usual(model: dict, quartiles: list[tuple[float, float]]) -> dict:
    """The model with thresholds above what is usual, from quartiles of all other runs' ratios by kind."""
    fences = [high + FENCE * (high - low) for low, high in quartiles]
    return model | {"thresholds": [max(t, f) for t, f in zip(model["thresholds"], fences, strict=True)]}


# --- Spark ------------------------------------------------------------------------------


def _examples(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        out = []
        for text in column.to_pylist():
            text = text or ""
            base = base_spans(text)
            found = {("other", m.group()) for m in other_runs(text, base)}
            for start, kind, end in base:
                value = text[start:end]
                found.add((KINDS[kind], ASSIGN.match(value)[2] if kind == 0 else value))
            out.append([{"kind": k, "value": v} for k, v in found])
        yield pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))


def distinct_values(docs: DataFrame) -> DataFrame:
    """All distinct labelled values and other runs, staged."""
    found = docs.select(F.explode(scan(_examples, "array<struct<kind: string, value: string>>")("text")).alias("x"))
    return stage(found.select("x.kind", "x.value").distinct())


def labelled_values(values: DataFrame, examples: int = EXAMPLES) -> dict[str, list[str]]:
    """Up to ``examples`` distinct values per kind, those with the smallest hash that are ``LEARNED`` together."""
    out = {}
    for kind in (*KINDS, "other"):
        most = examples * (ORDINARY if kind == "other" else 1)
        key = F.xxhash64("value")
        first = values.where(F.col("kind") == kind).orderBy(key, "value").limit(most).select("value", key.alias("key"), F.length("value").alias("n"))
        room, keys = LEARNED, []
        for r in first.select("key", "n").collect():
            if r.n <= room:
                keys.append(r.key)
                room -= r.n
        out[kind] = sorted(r.value for r in first.where(F.col("key").isin(keys)).select("value").collect()) if keys else []
    return out


def _ratios(shared, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array([ratios(shared.value, v) for v in column.to_pylist()], pa.list_(pa.float64()))


def fitted(docs: DataFrame, examples: int = EXAMPLES) -> dict:
    """The model, with thresholds over all distinct other runs."""
    values = distinct_values(docs)
    model = learn(labelled_values(values, examples))
    if not model["kinds"]:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = values.where("kind = 'other'").select(scan(_ratios, "array<double>", shared)("value").alias("r"))
    quartiles = [F.percentile_approx(F.col("r")[i], [0.25, 0.75], 10_000) for i in range(len(model["kinds"]))]
    found = scored.agg(*quartiles).first()
    return model if found[0] is None else above_usual(model, [tuple(q) for q in found])


def _spans(shared, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    model = shared.value
    names = [f"like_{k}" for k in model["kinds"]]
    known: dict[str, tuple[str, float] | None] = {}

    def judge(value: str) -> tuple[str, float] | None:
        over = [(r - t, n, r) for r, t, n in zip(ratios(model, value), model["thresholds"], names, strict=True)]
        best = max(over, default=(-1.0, "", 0.0))
        return (best[1], best[2]) if best[0] > 0 else None

    rank = {k: i for i, k in enumerate([*KINDS, *(f"like_{k}" for k in KINDS)])}
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    for column in columns:
        out = []
        for text in column.to_pylist():
            text = text or ""
            base = base_spans(text)
            found = [(s, k, e, None) for s, k, e in base]
            for m in other_runs(text, base):
                value = m.group()
                if value not in known:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[value] = judge(value)
                if (hit := known[value]) is not None:
                    found.append((m.start(), rank[hit[0]], m.end(), hit[1]))
            found.sort(key=lambda x: x[:2])
            kinds = list(rank)
            out.append([{"kind": kinds[k], "start": s, "end": e, "score": p} for s, k, e, p in found])
        yield pa.array(out, pa.list_(kind))


def with_secrets(docs: DataFrame, into: str = "secrets", examples: int = EXAMPLES) -> DataFrame:
    """``docs`` with all spans as an array of (kind, start, end, score), in code points.

    A column named like ``into`` is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, examples))
    return docs.withColumn(into, scan(_spans, SPANS, model)("text"))


def _redact(shared, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in columns:
        out = []
        for text, found in zip(texts.to_pylist(), next(_spans(shared, iter([texts]))).to_pylist(), strict=True):
            if found:
                parts, at = [], 0
                for s in found:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], "[secret]"]
                    at = max(at, s["end"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        yield pa.array(out, pa.string())


def redact(docs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``docs`` with every span replaced by ``[secret]``; no row is dropped."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, examples))
    return docs.withColumn("text", scan(_redact, "string", model)("text"))
