"""Similarity of normalised names, from 0 to 100."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the token sets; 0 if either is empty. A column expression."""
    ta, tb = (F.array_distinct(F.filter(F.split(x, " "), lambda t: t != "")) for x in (a, b))
    n = F.size(F.array_intersect(ta, tb))
    both = F.size(ta) + F.size(tb) - n
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(F.lit(100.0) * n / both)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of a at a time (bit vectors)."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 * 2 * common_subsequence(a, b) / n if n else 100.0


def token_set(a: str, b: str) -> float:
    """The best of three ratios over shared and own tokens; 100 if the tokens of one are all in the other, 0 if either has none."""
    ta, tb = set((a or "").split()), set((b or "").split())
    if not ta or not tb:
        return 0.0
    shared = " ".join(sorted(ta & tb))
    own_a, own_b = (" ".join(sorted(x)) for x in (ta - tb, tb - ta))
    if shared and (not own_a or not own_b):
        return 100.0
    all_a, all_b = (f"{shared} {x}" if shared else x for x in (own_a, own_b))
    found = [_ratio(all_a, all_b)]
    if shared:  # a prefix: its common subsequence with the whole is itself
        found += [100.0 * 2 * len(shared) / (len(shared) + len(x)) for x in (all_a, all_b)]
    return max(found)


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in seen:
            seen[pair] = token_set(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


SCORERS = {"jaccard": jaccard, "token_set": token_set_ratio}
