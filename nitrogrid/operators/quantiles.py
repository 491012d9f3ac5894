"""Exact order statistics without gathering a column in one task.

A mergeable sketch (``percentile_approx``, bounded size) brackets each wanted rank, a histogram of
the bracket finds the bucket that holds it, brackets narrow to that bucket while it is large, and
only the distinct values of the last one are put in order. Every column goes this way, whatever its
size. Like ``DataFrame.approxQuantile`` these functions run jobs and return a few numbers. The
sketch only narrows the search: a rank outside its bracket is an error, never a wrong result.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from nitrogrid.functions.classes import is_missing
from nitrogrid.functions.text import any_of

BUCKETS = 1000
ORDERED_ROWS = 1_000_000
NARROWINGS = 20


def exact_quantiles(df, columns, probabilities, accuracy=10_000):
    """Linear-interpolation quantiles: ``{column: [quantile, ...]}``, None for no values."""
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    clean = numbers.select(*[_present(numbers, c) for c in columns])
    targets = {(c, p): (c, p) for c in columns for p in probabilities}
    brackets = _brackets(clean, targets, accuracy)
    def position(n, p):
        return p * (n - 1)

    ranks = {t: math.floor(position(brackets[t][0], t[1])) for t in targets}
    found = _values_at(clean, targets, brackets, ranks)
    result = {c: [] for c in columns}
    for c in columns:
        for p in probabilities:
            n = brackets[c, p][0]
            if not n:
                result[c].append(None)
                continue
            value, following, _, _ = found[c, p]
            part = position(n, p) - ranks[c, p]
            result[c].append(value + (following - value) * part if part else value)
    return result


def value_at_share(df, column, share, rank, accuracy=10_000):
    """Value at ``rank(n)`` (from 0), which must lie near ``share * n``.

    Returns ``value, below, equal, k``: how many rows are smaller, how many are the same,
    and the rank. None for an empty column.
    """
    clean = df.select(_present(df, column))
    targets = {"t": (column, share)}
    brackets = _brackets(clean, targets, accuracy)
    n = brackets["t"][0]
    if not n:
        return None
    k = rank(n)
    value, _, below, equal = _values_at(clean, targets, brackets, {"t": k})["t"]
    return value, below, equal, k


def _present(df, name):
    column = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() in ("double", "float"):
        return F.when(~is_missing(column), column).alias(name)
    return column.alias(name)


def _brackets(clean, targets, accuracy):
    """``{target: (n, low, high)}`` with the wanted rank inside.

    One pass with one sketch per column, whatever the number of targets.
    """
    offsets = _offsets(accuracy)
    columns = sorted({c for c, _ in targets.values()})
    parts = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        shares = _edges(targets, c, offsets)
        parts += [
            F.count(x).alias(f"n{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
            F.percentile_approx(x, shares, accuracy).alias(f"edges{i}"),
        ]
    row = clean.agg(*parts).first()
    found = {}
    for t, (c, p) in targets.items():
        i = columns.index(c)
        n, low, high = row[f"n{i}"], row[f"min{i}"], row[f"max{i}"]
        if n:
            # the sketch may be off by a rank in `accuracy`, and by a few ranks of a short column
            wide = next((o for o in offsets if o >= offsets[0] + 3 / n), 1.0)
            edges = dict(zip(_edges(targets, c, offsets), row[f"edges{i}"]))
            low, high = edges.get(p - wide, low), edges.get(p + wide, high)
        found[t] = (n, low, high)
    return found


def _offsets(accuracy):
    """Distances from a wanted share at which a bracket may end, each twice the one before."""
    found = [4.0 / accuracy]
    while found[-1] < 1:
        found.append(found[-1] * 2)
    return found


def _edges(targets, column, offsets):
    shares = {p + sign * o for c, p in targets.values() if c == column for sign in (-1, 1) for o in offsets}
    return sorted(s for s in shares if 0 < s < 1) or [0.5]


def _values_at(clean, targets, brackets, ranks, narrowings=NARROWINGS):
    """``{target: (value at k, value at k + 1, rows below, rows equal)}``."""
    live = [t for t in targets if brackets[t][0]]
    if not live:
        return {}
    number = {t: i for i, t in enumerate(live)}

    def cell(t):
        return F.col(f"`{targets[t][0]}`")

    def bucket(t):
        _, low, high = brackets[t]
        x = cell(t).cast("double")
        return F.when(x.between(low, high), F.coalesce(
            F.width_bucket(x, F.lit(low), F.lit(high), F.lit(BUCKETS)), F.lit(0)
        ))

    below = clean.agg(*[
        F.count_if(cell(t).cast("double") < brackets[t][1]).alias(f"b{i}") for t, i in number.items()
    ]).first()

    # plain range tests first: few rows are left for the per-target work
    near = any_of([cell(t).cast("double").between(*brackets[t][1:]) for t in live])
    inside = clean.filter(near).select(F.explode(F.array_compact(F.array(*[
        F.when(bucket(t).isNotNull(), F.struct(
            F.lit(i).alias("t"), bucket(t).alias("bucket"), cell(t).alias("value"),
        )) for t, i in number.items()
    ]))).alias("h")).select("h.*")
    # at most BUCKETS + 2 rows per target
    sizes = inside.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("rows")).collect()

    hits, starts, narrower = [], {}, dict(brackets)
    for t, i in number.items():
        start, k = below[f"b{i}"], ranks[t]
        last = brackets[t][0] - 1
        for b, rows in sorted((r["bucket"], r["rows"]) for r in sizes if r["t"] == i):
            if start <= min(k + 1, last) and start + rows > k:
                hits.append((i, b))
                starts[i, b] = start
            start += rows
        n, low, high = brackets[t]
        mine = {b for j, b in hits if j == i}
        held = sum(r["rows"] for r in sizes if r["t"] == i and r["bucket"] in mine)
        if held > ORDERED_ROWS and high > low and narrowings:
            # the buckets' own range, a little wider than their edges
            step = (high - low) / BUCKETS
            narrower[t] = (n, max(low, low + (min(mine) - 1.001) * step), min(high, low + (max(mine) + 0.001) * step))
    if any(narrower[t][2] - narrower[t][1] < (brackets[t][2] - brackets[t][1]) / 2 for t in live):
        return _values_at(clean, targets, narrower, ranks, narrowings - 1)
    chosen = F.lit(False)
    for i, b in hits:
        chosen = chosen | ((F.col("t") == i) & (F.col("bucket") == b))
    order = Window.partitionBy("t", "bucket").orderBy("value")
    counted = inside.filter(chosen).groupBy("t", "bucket", "value").agg(F.count(F.lit(1)).alias("rows"))
    start_of = F.coalesce(*[
        F.when((F.col("t") == i) & (F.col("bucket") == b), F.lit(s)) for (i, b), s in starts.items()
    ])
    wanted = F.coalesce(*[F.when(F.col("t") == i, F.lit(ranks[t])) for t, i in number.items()])
    placed = counted.select(
        "t", "value", "rows", wanted.alias("k"),
        (start_of + F.sum("rows").over(order) - F.col("rows")).alias("first"),
    ).withColumn("last", F.col("first") + F.col("rows") - 1)
    at_k = F.col("k").between(F.col("first"), F.col("last"))
    at_next = (F.col("k") + 1).between(F.col("first"), F.col("last"))
    # at most two values per target
    picked = placed.filter(at_k | at_next).select("t", "value", "first", "rows", at_k.alias("at_k"),
                                                  at_next.alias("at_next")).collect()
    result = {}
    for t, i in number.items():
        mine = [r for r in picked if r["t"] == i]
        here = next((r for r in mine if r["at_k"]), None)
        after = next((r for r in mine if r["at_next"]), here)
        if here is None or (after is here and not here["at_next"] and ranks[t] < brackets[t][0] - 1):
            raise ArithmeticError(f"rank {ranks[t]} of {targets[t][0]} lies outside its bracket")
        result[t] = (here["value"], after["value"], here["first"], here["rows"])
    return result
