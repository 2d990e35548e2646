"""Session picks: an order-dependent choice, in Python on a bounded pool."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k


def session_pool(df: DataFrame, n_sessions: int, picks: int) -> DataFrame:
    """What session_picks() can take at all: of each family the best n_sessions * picks by the order of each session."""
    pool = None
    for s in range(n_sessions):
        best = top_k(df, ["family"], [F.get("priorities", F.lit(s)), F.desc("weight"), F.col("item")], n_sessions * picks, "__place").drop("__place")
        pool = best if pool is None else pool.unionByName(best)
    return pool.dropDuplicates(["item"])


def session_picks(df: DataFrame, sessions: list[list[str]], picks: int = 4) -> DataFrame:
    """session, place, item, family: for each session the first unused item of each of its families, then the first unused ones.

    df: item, family, weight, priorities (one number for each session; smaller first, then heavier, then the smaller item).
    Families are few; what one task sees is session_pool(), at most sessions^2 * picks rows a family.
    """
    pool = session_pool(df.select("item", "family", "weight", "priorities"), len(sessions), picks)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for f in frames for r in f.itertuples(index=False)]
        used: set[int] = set()
        out = []
        for s, families in enumerate(sessions):
            ordered = sorted(rows, key=lambda r: (r.priorities[s], -r.weight, r.item))
            taken = []
            for family in families:
                taken += [r for r in ordered if r.family == family and r.item not in used and all(r is not t for t in taken)][:1]
                used |= {r.item for r in taken}
            for r in ordered:
                if len(taken) < picks and r.item not in used:
                    taken.append(r)
                    used.add(r.item)
            out += [(s + 1, place, r.item, r.family) for place, r in enumerate(taken, 1)]
        yield pd.DataFrame(out, columns=["session", "place", "item", "family"])

    return pool.coalesce(1).mapInPandas(choose, "session int, place int, item long, family string")
