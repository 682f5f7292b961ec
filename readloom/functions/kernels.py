"""Dynamic programming that has no built-in counterpart, batched through Arrow."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def infix_distance(needle: str, haystack: str) -> int:
    """Fewest edits that turn needle into some substring of haystack (bit-parallel over the needle)."""
    m = len(needle)
    if m == 0:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(needle):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in haystack:
        eq = masks.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diag | up)), up & diag
        if plus & top:
            score += 1
        if minus & top:
            score -= 1
            best = min(best, score)
        # no bit is carried in: a match may start anywhere in the haystack
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(diag | plus)), plus & diag
    return best


def local_score(a: str, b: str) -> int:
    """Best local alignment at +1 a match, -1 a mismatch and -1 a gap base."""
    x = np.frombuffer(a.encode("latin-1", "replace"), np.uint8)
    y = np.frombuffer(b.encode("latin-1", "replace"), np.uint8)
    if not len(x) or not len(y):
        return 0
    ramp, best = np.arange(len(y) + 1), 0
    row = np.zeros(len(y) + 1, np.int64)
    for c in x:
        step = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(y == c, 1, -1), row[1:] - 1, out=step[1:])
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + ramp) - ramp  # a gap to the left costs one a base
        best = max(best, int(row.max()))
    return best


@F.pandas_udf(T.IntegerType())
def infix_edit_distance(needle: pd.Series, haystack: pd.Series) -> pd.Series:
    seen: dict[tuple, int] = {}
    out = []
    for pair in zip(needle, haystack):
        if None in pair:
            out.append(None)
            continue
        if pair not in seen:
            seen[pair] = 0 if pair[0] in pair[1] else infix_distance(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="Int32")


@F.pandas_udf(T.IntegerType())
def local_alignment_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else local_score(x, y) for x, y in zip(a, b)], dtype="Int32")
