"""Triples ``(s, p, o)`` as a bag: append, substring search, patterns, joined patterns, delete."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.frames import union_all
from ..functions.matching import find_contained
from ..session import materialize
from .keys import bag_difference

POSITIONS = ("s", "p", "o")


def triple_text() -> Column:
    return F.concat_ws(" ", *POSITIONS)


def add_triples(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append; duplicates are kept."""
    return store.unionByName(incoming)


def search_triples(triples: DataFrame, text: str) -> DataFrame:
    """Triples whose ``"s p o"`` text contains ``text``, case-sensitive."""
    return triples.filter(triple_text().contains(text))


def batch_search_triples(triples: DataFrame, queries: DataFrame) -> DataFrame:
    """The same for a table of queries: ``query_id, s, p, o``."""
    found = find_contained(triples.withColumn("_text", triple_text()), "_text", queries)
    return found.select("query_id", *POSITIONS)


def _is_variable(term: str | None) -> bool:
    return term is None or term.startswith("?")


def match_pattern(triples: DataFrame, pattern: Sequence[str | None]) -> DataFrame:
    """Triples fitting ``(s, p, o)``; ``None`` or ``?name`` matches anything.

    Fixed positions become filters the scan can push down; a name used twice must match itself.
    """
    seen: dict[str, str] = {}
    for position, term in zip(POSITIONS, pattern):
        if not _is_variable(term):
            triples = triples.filter(F.col(position) == term)
        elif term and term in seen:
            triples = triples.filter(F.col(position) == F.col(seen[term]))
        elif term:
            seen[term] = position
    return triples


def _bind(triples: DataFrame, pattern: Sequence[str | None]) -> DataFrame:
    """Matches of one pattern with a column per variable."""
    names = {term[1:]: position for position, term in zip(POSITIONS, pattern) if term and term.startswith("?")}
    return match_pattern(triples, pattern).select(*[F.col(position).alias(name) for name, position in names.items()])


def match_patterns(triples: DataFrame, patterns: Sequence[Sequence[str | None]]) -> DataFrame:
    """Several patterns joined on the variables they share: a column per variable, a row per way all of them hold.

    Three patterns that close a cycle are joined by ``_triangle``. Others are joined in the order of their counted
    matches, the fewest first, each next to one it shares a variable with.
    """
    bound = [_bind(triples, p) for p in patterns]
    names = list(dict.fromkeys(c for b in bound for c in b.columns))
    if _is_triangle(bound):
        return _triangle(bound).select(*names)
    left = list(range(len(patterns)))
    if len(left) > 2:
        sizes = [b.count() for b in bound]
        left.sort(key=lambda i: (sizes[i], i))
    result = bound[left.pop(0)]
    while left:
        after = next((i for i in left if set(bound[i].columns) & set(result.columns)), None)
        if after is None:
            raise RequestError(f"Pattern {tuple(patterns[left[0]])} shares no variable with the others.")
        left.remove(after)
        result = result.join(bound[after], [c for c in result.columns if c in bound[after].columns])
    return result.select(*names)


#: Matches of the patterns of a cycle that one group of its shuffle holds, about.
CELL_ROWS = 100_000
#: Two patterns of a cycle are joined first if that gives at most so many rows for each match of the three.
OPEN_ROWS = 2


def _is_triangle(bound: Sequence[DataFrame]) -> bool:
    pairs = [frozenset(b.columns) for b in bound]
    return len(pairs) == 3 and len(set(pairs)) == 3 and all(len(p) == 2 for p in pairs) and len(frozenset.union(*pairs)) == 3


def _triangle(bound: Sequence[DataFrame]) -> DataFrame:
    """All ways three patterns over (x, y), (y, z) and (z, x) hold together, with their copies.

    The rows that two of the patterns give are counted from how often they have each value of the variable they share. If the
    fewest are no more than ``OPEN_ROWS`` for each match, as where a variable decides another, these two are joined and the third closes
    them: work grows with the matches. Else they meet in ``_shared``.
    """
    names = list(dict.fromkeys(c for b in bound for c in b.columns))
    counted = [
        materialize(b.groupBy(*b.columns).agg(F.count(F.lit(1)).alias("_n")).filter(" and ".join(f"`{c}` is not null" for c in b.columns)), "matches")
        for b in bound
    ]
    rows = sum(c.count() for c in counted)
    opened = {pair: _open_rows(counted[pair[0]], counted[pair[1]]) for pair in ((0, 1), (1, 2), (0, 2))}
    i, j = min(opened, key=opened.get)
    if opened[i, j] <= OPEN_ROWS * rows:
        copies = reduce(lambda a, b: a * b, [F.col(f"_n{k}") for k in range(3)])
        first, second, third = (counted[k].withColumnRenamed("_n", f"_n{at}") for at, k in enumerate((i, j, 3 - i - j)))
        path = first.join(second, _shared_names(first, second))
        found = path.join(third, _shared_names(path, third)).withColumn("_n", copies)
    else:
        found = _shared(counted, names, rows)
    return found.select(*(F.col(f"`{k}`") for k in names), F.explode(F.expr("sequence(1L, _n)")).alias("_copy")).drop("_copy")


def _shared_names(a: DataFrame, b: DataFrame) -> list[str]:
    return [k for k in a.columns if k in b.columns and k != "_n"]


def _open_rows(a: DataFrame, b: DataFrame) -> float:
    """Rows of ``a`` joined with ``b`` on the variable they share."""
    (name,) = _shared_names(a, b)
    sizes = [c.groupBy(name).agg(F.count(F.lit(1)).cast("double").alias(f"_rows{i}")) for i, c in enumerate((a, b))]
    return sizes[0].join(sizes[1], name).agg(F.sum(F.col("_rows0") * F.col("_rows1"))).first()[0] or 0.0


def _shared(counted: Sequence[DataFrame], names: Sequence[str], rows: int) -> DataFrame:
    """The ways three counted patterns in a cycle hold together, ``names`` and ``_n``.

    Values of each variable are dealt into ``shares`` parts, and a group gets the matches whose values fall into its three parts: every
    match goes to ``shares`` groups, and a value with very many matches is spread over shares ** 2 of them. Inside a group
    the lists of a match's two ends are intersected, so nothing is ever larger than the matches and the result.
    """
    shares = max(2, round((rows / CELL_ROWS) ** 0.5))

    def part(name: str) -> Column:
        return F.pmod(F.xxhash64(f"`{name}`"), F.lit(shares)).cast("int")

    tagged = []
    for i, c in enumerate(counted):
        x, y = (k for k in c.columns if k != "_n")
        free = next(k for k in names if k not in (x, y))
        cell = {k: part(k) for k in (x, y)} | {free: F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))}
        tagged.append(c.select(F.lit(i).alias("_pattern"), *(cell[k].alias(f"_cell{j}") for j, k in enumerate(names)), F.col(f"`{x}`").alias("_x"), F.col(f"`{y}`").alias("_y"), "_n"))
    ends = [tuple(k for k in c.columns if k != "_n") for c in counted]
    schema = ", ".join(f"`{k}` string" for k in names) + ", _n long"

    def close(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [frame.loc[frame["_pattern"] == i, ["_x", "_y", "_n"]] for i in range(3)]
        first = min(range(3), key=lambda i: len(parts[i]))  # go through the fewest matches
        x, y = ends[first]
        lists = {}
        for i in range(3):
            if i != first:
                own = x if x in ends[i] else y
                mine = parts[i].rename(columns=dict(zip(("_x", "_y"), ends[i], strict=True)))
                free = next(k for k in ends[i] if k != own)
                lists[own] = (free, {k: dict(zip(g[free], g["_n"], strict=True)) for k, g in mine.groupby(own)})
        (free, of_x), (_, of_y) = lists[x], lists[y]
        out = []
        for a, b, n in zip(parts[first]["_x"], parts[first]["_y"], parts[first]["_n"], strict=True):
            short, long = sorted((of_x.get(a, {}), of_y.get(b, {})), key=len)
            out.extend((a, b, c, n * m * long[c]) for c, m in short.items() if c in long)
        return pd.DataFrame(out, columns=[x, y, free, "_n"])[[*names, "_n"]]

    cells = union_all(tagged).groupBy("_cell0", "_cell1", "_cell2")
    return cells.applyInPandas(close, schema)


def delete_triples(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove one occurrence per listed triple; absent ones are ignored."""
    return bag_difference(triples.select(*POSITIONS), gone.select(*POSITIONS))
