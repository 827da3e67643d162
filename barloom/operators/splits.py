"""Ordering, splitting and ranking of a panel without a global sort.

A split needs the row that stands at a given position, not a rank on every
row. The position is found from counts per bucket (a calendar day, or a prefix
of a hash), and only the bucket that holds it is ordered. All other rows are
labelled by comparing their key with that row: no shuffle of the panel.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.functions.search import with_place
from barloom.schema import KEY, TIME
from barloom.session import spread


_SLICES = 64

# Parts of the positions for each task, at most and at least so many rows in one; a day with more rows than that is cut at so many symbols.
_PARTS, _PART_ROWS, _LEAST_ROWS = 4, 1 << 17, 1 << 12
_DAY_ROWS, _KEY_EDGES = 1 << 18, 1023


def _sliced(rows: DataFrame, keys: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` plus ``_slice``: which of 64 ordered key ranges a row falls in.

    The range edges are the 63 keys with the smallest hashes, a fixed number
    whatever the table holds. They only decide how the work is cut up, so that
    a bucket with a large share of all rows is not ordered by one task.
    """
    key = F.struct(*order)
    few = keys.select(key.alias("_e")).orderBy(F.xxhash64("_e"), "_e").limit(_SLICES - 1)
    edges = few.agg(F.array_sort(F.collect_list("_e"))).scalar()
    marked = rows.withColumn("_edges", edges)
    return with_place(marked, "_slice", "_edges", _SLICES - 1, lambda e: e <= key).drop("_edges")


def in_buckets(keys: DataFrame, bucket: Column, values: list) -> DataFrame:
    """The rows of a few buckets; a plain column reaches the scan as a pushed filter."""
    return keys.filter(bucket.isin(values))


def rows_at(
    keys: DataFrame, bucket: Column, order: list[str], positions: Callable[[Column], Column]
) -> dict[int, Row]:
    """The rows at given 0-based positions as ``{k: row of order}``, in two passes over ``keys``.

    ``order`` is a unique key and ``bucket`` monotone in it. ``positions`` maps the total row count to an array of
    positions; those outside the table are left out. The first pass counts buckets and tells which of them hold a position; the
    second reads those buckets alone, a filter on ``bucket`` that reaches the scan, and orders them
    in slices of the key. At most one short row per position comes to the driver.
    """
    counts = keys.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    # one row per bucket; buckets are days or 16-bit prefixes
    everything = Window.partitionBy(F.lit(0))
    so_far = everything.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(
        "_bucket",
        "_n",
        (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"),
        F.sum("_n").over(everything).alias("_total"),
    )
    wanted = counts.select(
        "_bucket", "_n", "_before", F.posexplode(positions(F.col("_total"))).alias("k", "position")
    ).filter((F.col("position") >= F.col("_before")) & (F.col("position") < F.col("_before") + F.col("_n")))
    wanted = wanted.select("k", "_bucket", (F.col("position") - F.col("_before")).alias("_at")).collect()
    if not wanted:
        return {}
    cut = sorted({r["_bucket"] for r in wanted})
    inside = in_buckets(keys, bucket, cut).select(bucket.alias("_bucket"), *order).persist()
    try:
        sliced = _sliced(inside, inside, order)
        sizes = sliced.groupBy("_bucket", "_slice").count().orderBy("_bucket", "_slice").collect()  # 64 rows per cut bucket
        places = []
        for r in wanted:
            left = r["_at"]
            for size in sizes:
                if size["_bucket"] == r["_bucket"]:
                    if left < size["count"]:
                        places.append((r["k"], r["_bucket"], size["_slice"], left + 1))
                        break
                    left -= size["count"]
        number = F.row_number().over(Window.partitionBy("_bucket", "_slice").orderBy(*order))
        at = lambda p: (F.col("_bucket") == F.lit(p[1])) & (F.col("_slice") == p[2])
        some = functools.reduce(Column.__or__, [at(p) for p in places])
        k = F.array_compact(F.array(*[F.when(at(p) & (F.col("_number") == p[3]), F.lit(p[0])) for p in places]))
        found = sliced.filter(some).withColumn("_number", number).select(F.explode(k).alias("k"), *order)
        return {r["k"]: r for r in found.collect()}
    finally:
        inside.unpersist()


def _boundaries(keys: DataFrame, found: dict[int, Row], fields: list[str]) -> dict[int, Column]:
    """The found rows' keys as literals, by k."""
    types = dict(keys.dtypes)
    return {k: F.struct(*[F.lit(r[f]).cast(types[f]).alias(f) for f in fields]) for k, r in found.items()}


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def split_train_test(
    panel: DataFrame,
    test_size: float = 0.2,
    time_based: bool = True,
    by_date: bool = False,
    embargo: int = 0,
    seed: int = 42,
) -> DataFrame:
    """``panel`` plus ``split``: the first rows in (Date, Symbol) order train.

    ``by_date`` keeps a day on one side. ``embargo=h`` removes train rows whose
    h-bar label reaches the first test day. ``time_based=False`` draws the test
    rows by a seeded hash of the key, with exact sizes.
    """
    if not time_based:
        return _random_split(panel, test_size, seed)
    share = 1 - test_size
    cut = rows_at(panel.select(TIME, KEY), F.col(TIME), [TIME, KEY], lambda n: F.array(_whole(n * F.lit(share))))
    edge = _boundaries(panel, cut, [TIME, KEY]).get(0)
    if edge is None:
        return panel.withColumn("split", F.lit("train"))
    before = F.col(TIME) < edge[TIME] if by_date else F.struct(TIME, KEY) < edge
    side = F.when(before, "train").otherwise("test")
    marked = panel
    if embargo:
        marked = marked.withColumn("_ends", F.lead(TIME, embargo).over(W.by_symbol()))
        reaches = (side == "train") & F.coalesce(F.col("_ends") >= edge[TIME], F.lit(False))
        marked = marked.filter(~reaches)
    return marked.select(*panel.columns, side.alias("split"))


def _random_split(panel: DataFrame, test_size: float, seed: int) -> DataFrame:
    drawn = F.xxhash64(F.lit(seed), F.col(KEY), F.col(TIME))
    keys = panel.select(KEY, TIME, drawn.alias("_h"))
    fields = ["_h", KEY, TIME]
    cut = rows_at(
        keys, F.shiftright("_h", 48), fields, lambda n: F.array(F.ceil(n * F.lit(test_size)).cast("long"))
    )
    edge = _boundaries(keys, cut, fields).get(0)
    if edge is None:
        return panel.withColumn("split", F.lit("test"))
    test = F.struct(drawn.alias("_h"), KEY, TIME) < edge
    return panel.select(*panel.columns, F.when(test, "test").otherwise("train").alias("split"))


def fold_edges(panel: DataFrame, n_splits: int, test_size: float) -> dict[int, Column]:
    """The first test row's key of each walk-forward fold, by fold from 0; folds without a train row are left out."""

    def starts(n):
        size = _whole(n * F.lit(test_size))
        first = n - n_splits * size
        at = [first + k * size for k in range(n_splits)]
        return F.array(*[F.when(x > 0, x).otherwise(F.lit(-1).cast("long")) for x in at])

    fields = [TIME, KEY]
    keys = panel.select(*fields)
    return _boundaries(keys, rows_at(keys, F.col(TIME), fields, starts), fields)


def walk_forward_splits(
    panel: DataFrame, n_splits: int = 5, test_size: float = 0.1, embargo: int = 0
) -> DataFrame:
    """One copy of a row per fold it takes part in, with ``fold`` and ``role``.

    Fold ``k`` trains on everything before its test block; blocks follow each
    other and end with the last row. Folds without a train row are left out.
    """
    fields = [TIME, KEY]
    edges = fold_edges(panel, n_splits, test_size)
    marked = panel
    if embargo:
        marked = marked.withColumn("_ends", F.lead(TIME, embargo).over(W.by_symbol()))
    own = F.struct(*fields)
    roles = []
    for k in sorted(edges):
        start, stop = edges[k], edges.get(k + 1)
        train = own < start
        if embargo:
            train &= F.coalesce(F.col("_ends") < start[TIME], F.lit(True))
        test = own >= start if stop is None else (own >= start) & (own < stop)
        role = F.when(train, "train").when(test, "test")
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(k + 1).alias("fold"), role.alias("role"))))
    if not roles:
        empty = [F.lit(None).cast("int").alias("fold"), F.lit(None).cast("string").alias("role")]
        return panel.limit(0).select(*panel.columns, *empty)
    taken = F.explode(F.array_compact(F.array(*roles))).alias("_fold")
    return marked.select(*panel.columns, taken).select(*panel.columns, "_fold.fold", "_fold.role")


def fold_rows(panel: DataFrame, edges: dict[int, Column], fold: int, embargo: int = 0) -> DataFrame:
    """The rows of one fold, with ``role``: a filter on ``panel``, whose date bound reaches the scan."""
    start, stop = edges[fold], edges.get(fold + 1)
    own = F.struct(TIME, KEY)
    rows = panel
    if embargo:
        rows = rows.withColumn("_ends", F.lead(TIME, embargo).over(W.by_symbol()))
    if stop is not None:
        rows = rows.filter((F.col(TIME) <= stop[TIME]) & (own < stop))
    if embargo:
        rows = rows.filter((own >= start) | F.coalesce(F.col("_ends") < start[TIME], F.lit(True)))
    return rows.select(*panel.columns, F.when(own < start, "train").otherwise("test").alias("role"))


def with_rank(
    rows: DataFrame, bucket: Column | None = None, order: list[str] | None = None, name: str = "rank"
) -> DataFrame:
    """0-based position as ``name``, in (Date, Symbol) order by default.

    Counts per bucket and key slice give the position each starts at; rows are
    numbered within theirs only.
    """
    bucket = F.col(TIME) if bucket is None else bucket
    order = order or [TIME, KEY]
    marked = _sliced(rows.withColumn("_bucket", bucket), rows, order)
    counts = marked.groupBy("_bucket", "_slice").agg(F.count("*").alias("_n"))
    # days (or 16-bit prefixes) times 64 rows
    so_far = Window.partitionBy(F.lit(0)).orderBy("_bucket", "_slice").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select("_bucket", "_slice", (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket", "_slice").orderBy(*order)) - 1
    ranked = marked.join(starts, ["_bucket", "_slice"])
    return ranked.select(*rows.columns, (F.col("_before") + inside).alias(name))


def with_partner(rows: DataFrame, drawn: Column, kept: list[str], columns: list[str], name: str) -> DataFrame:
    """Columns ``kept`` of every row, and as struct ``name`` the ``columns`` of the row that stands at the same position in the
    order of ``drawn``, a hexadecimal digest of the (unique) key. The first order is (Date, Symbol); rows without a
    day come first there and are left out.

    Counts per day and per digest prefix tell the position at which each of them starts, so a row goes straight to the part of the
    positions it belongs to: one shuffle of rows and partners. Prefixes at the edge of a part go to both sides of it. Each part is
    sorted and matched on its own. ``rows`` is read several times.
    """
    spark = rows.sparkSession
    prefix = F.substring(drawn, 1, 4)
    days = {(r[0], 0): r[1] for r in rows.groupBy(TIME).count().collect()}  # one row per day
    prefixes = sorted(map(tuple, rows.groupBy(prefix).count().collect()))  # 16 bits
    busy = [d for (d, _), n in days.items() if d is not None and n > _DAY_ROWS]
    sliced = rows.withColumn("_slice", F.lit(0))
    if busy:
        inside = in_buckets(rows, F.col(TIME), busy)
        few = inside.select(KEY).orderBy(F.xxhash64(KEY, TIME), KEY, TIME).limit(_KEY_EDGES)
        edges = few.agg(F.array_sort(F.collect_set(KEY))).first()[0]
        held = F.lit(edges) if edges else F.array().cast("array<string>")
        marked = lambda t: with_place(t.withColumn("_edges", held), "_slice", "_edges", _KEY_EDGES, lambda e: e <= F.col(KEY))
        sizes = marked(inside).groupBy(TIME, "_slice").count().collect()
        days = {k: n for k, n in days.items() if k[0] not in set(busy)} | {(r[0], r[1]): r[2] for r in sizes}
        sliced = marked(rows).withColumn("_slice", F.when(F.col(TIME).isin(busy), F.col("_slice")).otherwise(F.lit(0)))
    own, others, ahead = _routes(days, prefixes, int(spark.conf.get("spark.sql.shuffle.partitions")))

    day_type = rows.schema[TIME].dataType.simpleString()
    own = F.broadcast(spark.createDataFrame(own, f"{TIME} {day_type}, _slice int, _part int"))
    others = F.broadcast(spark.createDataFrame(others, "_prefix string, _part int"))
    carried = list(dict.fromkeys(kept + columns))
    given = [F.col(c) if c in columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in carried]
    left = sliced.join(own, [TIME, "_slice"]).select("_part", F.lit(False).alias("_drawn"), TIME, KEY, *carried)
    right = rows.withColumn("_prefix", prefix).join(others, "_prefix")
    right = right.select("_part", F.lit(True).alias("_drawn"), TIME, KEY, *given)
    both = spread(left.union(right), "_part").withColumn("_h", F.when(F.col("_drawn"), drawn))

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = [f"`_own_{c}` {types[c]}" for c in kept] + [f"`_other_{c}` {types[c]}" for c in columns]

    def matched(part: pa.Table) -> pa.Table:
        return _matched(part, ahead[part["_part"][0].as_py()], kept, columns)

    met = both.groupBy("_part").applyInArrow(matched, ", ".join(schema))
    partner = F.struct(*[F.col(f"`_other_{c}`").alias(c) for c in columns]).alias(name)
    return met.select(*[F.col(f"`_own_{c}`").alias(c) for c in kept], partner)


def _routes(days: dict[tuple, int], prefixes: list[tuple[str, int]], tasks: int) -> tuple[list, list, dict[int, int]]:
    """The part that the rows of each ``(day, slice)`` go to, the parts of each prefix, and how many positions before a part
    the first prefix sent there starts."""
    total = sum(days.values())
    parts = max(1, min(max(_PARTS * tasks, total // _PART_ROWS), total // _LEAST_ROWS))
    own, numbers, starts, at = [], [], [], 0
    for (day, piece), n in sorted(days.items(), key=lambda x: (x[0][0] is not None, *x[0])):
        if day is not None:
            number = at * parts // total
            if not numbers or numbers[-1] != number:
                numbers.append(number)
                starts.append(at)
            own.append((day, piece, number))
        at += n
    others, ahead, at = [], {}, 0
    for digits, n in prefixes:
        k = max(0, bisect.bisect_right(starts, at) - 1)
        while k < len(starts) and starts[k] < at + n:
            others.append((digits, numbers[k]))
            ahead.setdefault(numbers[k], starts[k] - at)
            k += 1
        at += n
    return own, others, ahead


def _matched(part: pa.Table, ahead: int, kept: list[str], columns: list[str]) -> pa.Table:
    """Rows of a part beside the drawn ones at the same positions, of which ``ahead`` lie before the part."""
    part = part.combine_chunks()

    def sorted_by(side, *names):
        rows = part.filter(side)
        return rows.take(pc.sort_indices(rows, sort_keys=[(n, "ascending") for n in names], null_placement="at_start"))

    own, others = sorted_by(pc.invert(part["_drawn"]), TIME, KEY), sorted_by(part["_drawn"], "_h", KEY, TIME)
    own, others = own.slice(0, max(0, others.num_rows - ahead)), others.slice(ahead, own.num_rows)
    return pa.table({f"_own_{c}": own[c] for c in kept} | {f"_other_{c}": others[c] for c in columns})


def in_order(panel: DataFrame) -> DataFrame:
    return panel.orderBy(TIME, KEY)


def latest_rows(panel: DataFrame, n: int, spare: int = 5) -> DataFrame:
    """The newest ``n`` rows per symbol; symbols with fewer than ``n + spare`` go.

    The limit on the row number comes first: each task hands on at most ``n + spare`` rows of a symbol, and their number tells
    whether it has enough.
    """
    newest = Window.partitionBy(KEY).orderBy(F.desc(TIME))
    aged = panel.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= n + spare)
    counted = aged.withColumn("_rows", F.count("*").over(Window.partitionBy(KEY)))
    return counted.filter((F.col("_rows") >= n + spare) & (F.col("_age") <= n)).drop("_rows", "_age")


def top_rows(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The ``n`` largest with their place, 1 first."""
    top = df.orderBy(F.desc(by), tie).limit(n)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(by), tie)
    return top.withColumn("place", F.row_number().over(order))
