"""Small documents and the definition of a join, for tests in any folder."""

from __future__ import annotations

GOLDEN = [
    (1, {"a": "1", "b": "2"}),
    (2, {"a": "1", "c": "3"}),
    (3, {"a": "2", "b": "2"}),
    (4, {"b": "2", "c": "3"}),
    (5, {"d": "9"}),
    (6, {}),
]


def joinable(x: dict, y: dict) -> bool:
    common = x.keys() & y.keys()
    return bool(common) and all(x[k] == y[k] for k in common)


def brute_couples(rows) -> set:
    """The definition, document against document."""
    rows = [(0, *r) if len(r) == 2 else r for r in rows]
    return {
        (wx, min(a, b), max(a, b))
        for i, (wx, a, x) in enumerate(rows)
        for wy, b, y in rows[i + 1 :]
        if wx == wy and joinable(x, y)
    }


def as_set(df, *cols) -> set:
    """Rows as a set; fails on duplicates."""
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert len(got) == len(set(got)), "duplicate rows"
    return set(got)
