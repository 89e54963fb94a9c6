"""Order statistics that never put a whole table into one task.

A plain ``row_number() over (order by x)`` or exact ``percentile`` gathers all
rows (or all distinct values) in one place. Here the sort is range-partitioned
and only one number per slice is combined, and quantiles are found by
narrowing to the few rows around the wanted rank.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import as_column
from ledgerlens.session import materialize

_SKETCH_ACCURACY = 20_000  # rank error 1/20000, a quarter of the default slack
_SLICE_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _sorted_slices(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    # Range bounds come from a random sample, so the sorted rows are written once
    # and both the slice sizes and the positions are read from that one copy.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()))
    return written.withColumn("_slice", F.shiftright("_at", _SLICE_BITS))


def _slice_offsets(slices: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    # One row per range partition: the window and the broadcast below are bounded
    # by the shuffle partition count, whatever the data size.
    per_slice = slices.groupBy("_slice").agg(*[F.sum(c).alias(f"_off_{n}") for n, c in totals.items()])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        "_slice",
        *[F.coalesce(F.sum(f"_off_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals],
    )


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition on equal keys, NULL being equal to NULL."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def salted_join(facts: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table of any size with one row per key, a key's rows being spread over all partitions.

    Every row of ``small`` is repeated for each salt, so a key that holds a large share of ``facts`` is
    no larger task than the others. NULL keys match NULL keys; ``small`` must not share other columns.
    """
    salts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = facts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.withColumnsRenamed({k: f"_key_{k}" for k in [*keys, "_salt"]})
    condition = left["_salt"] == right["_key__salt"]
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"_key_{k}"])
    return left.join(right, condition, how).drop("_salt", "_key__salt", *[f"_key_{k}" for k in keys])


def global_row_number(
    df: DataFrame,
    order_by: Sequence[Column | str],
    alias: str = "row_no",
    by: Sequence[str] = (),
    size: str | None = None,
) -> DataFrame:
    """``row_number() over (partition by <by> order by <order_by>)`` without a hot task.

    ``order_by`` should end in a unique key so that the numbering is determined.
    Groups may be of any size: rows are spread by range, and where a group starts is
    looked up by (slice, group), never by group alone. NULL is a group of its own.
    ``size`` names a column for the rows of the group.
    """
    order = [F.col(b) for b in by] + [as_column(c) for c in order_by]
    slices = _sorted_slices(df, order)
    inside = F.col("_at").bitwiseAND(F.lit((1 << _SLICE_BITS) - 1))
    # one row for each slice and group in it
    runs = slices.groupBy("_slice", *by).agg(F.min(inside).alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_slice").alias("_run_slice"), *[F.col(b).alias(f"_run_{b}") for b in by],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("_size"))
    condition = F.col("_slice") == F.col("_run_slice")
    for b in by:
        condition = condition & F.col(b).eqNullSafe(F.col(f"_run_{b}"))
    numbered = slices.join(runs, condition)
    extra = [F.col("_size").cast("bigint").alias(size)] if size else []
    return numbered.select(*df.columns, (inside + F.col("_shift") + 1).cast("bigint").alias(alias), *extra)


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column | str],
    totals: Mapping[str, Column | str],
) -> DataFrame:
    """Inclusive running sums over a global order, one new column per entry."""
    sums = {name: as_column(c) for name, c in totals.items()}
    slices = _sorted_slices(df, [as_column(c) for c in order_by])
    offsets = _slice_offsets(slices, sums)
    inside = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = slices.select("*", *[F.sum(c).over(inside).alias(f"_run_{n}") for n, c in sums.items()])
    return local.join(F.broadcast(offsets), "_slice").select(
        *df.columns, *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums]
    )


def equal_count_bin(row_no: Column, n: Column, bins: int) -> Column:
    """Equal-frequency bin (1..bins) of a row number, linear-interpolation edges.

    Row r falls in the first bin i with r <= 1 + i/bins * (n - 1).
    """
    raw = F.floor((F.lit(bins) * (row_no - 1) + n - 2) / F.nullif(n - 1, F.lit(0)))
    return F.greatest(F.lit(1), F.coalesce(raw, F.lit(1))).cast("int")


Pair = tuple[float, object]


def after(value: Column, key: Column, cut: Pair) -> Column:
    """Whether (value, key) comes after ``cut`` in their order; no value is less than any."""
    v = F.coalesce(value.cast("double"), F.lit(float("-inf")))
    return (v > cut[0]) | ((v == cut[0]) & (key > F.lit(cut[1])))


def rows_at_ranks(
    df: DataFrame, columns: Sequence[str], key: str, places: Callable[[int], Sequence[int]], bound: int = 4096,
) -> tuple[int, dict[str, list[Pair]]]:
    """The number of rows n, and for each column the (value, key) of the rows at the ranks ``places(n)`` (from 1).

    Multiple selection without a sort: a hash sample of at most ``bound`` rows proposes edges around every wanted
    rank, one aggregation counts the rows up to each edge exactly, and the next sample is drawn between the edges,
    until no more rows than ``bound`` lie there. Ties of a value are told apart by ``key``, which is unique
    and never null, so a value that a third of the rows share is narrowed like any other. Nothing is shuffled but
    counts; ``df`` is read a few times: pass a stored table.
    """
    narrow = df.select(F.col(key).alias("_k"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(f"_v{i}") for i, c in enumerate(columns)])

    def sample(rows: DataFrame) -> list:
        return rows.orderBy(F.xxhash64("_k"), "_k").limit(bound + 1).collect()

    first = sample(narrow)
    n = len(first) if len(first) <= bound else narrow.count()
    out = {}
    for i, c in enumerate(columns):
        held = sorted((r[f"_v{i}"], r["_k"]) for r in first)
        out[c] = [held[r - 1] for r in places(n)] if n == len(first) else _select(narrow, f"_v{i}", held, places(n), n, bound, sample)
    return n, out


def _select(narrow: DataFrame, column: str, held: list[Pair], ranks: Sequence[int], n: int, bound: int, sample: Callable[[DataFrame], list]) -> list[Pair]:
    """``rows_at_ranks`` of one column beyond ``bound`` rows; ``held`` is a sorted sample of it."""
    value, key = F.col(column), F.col("_k")
    low: dict[int, tuple[Pair | None, int]] = {r: (None, 0) for r in ranks}  # before the row, with the rows up to it
    high: dict[int, tuple[Pair | None, int]] = {r: (None, n) for r in ranks}

    def inside(pair: Pair, r: int) -> bool:
        return (low[r][0] is None or pair > low[r][0]) and (high[r][0] is None or pair <= high[r][0])

    while True:
        edges = set()
        for r in ranks:
            own = [p for p in held if inside(p, r)]
            at = (r - low[r][1]) * len(own) / max(1, high[r][1] - low[r][1])
            slack = 1 + 1.5 * len(own) ** 0.5
            edges |= {own[max(0, min(len(own) - 1, int(p)))] for p in (at - slack, at + slack)} if own else set()
        ordered = sorted(edges)
        counts = narrow.agg(*[F.count_if(~after(value, key, e)).alias(f"c{j}") for j, e in enumerate(ordered)]).first()
        for e, c in zip(ordered, counts):
            for r in ranks:
                if c < r and inside(e, r):
                    low[r] = (e, c)
                elif c >= r and (high[r][0] is None or e < high[r][0]):
                    high[r] = (e, c)
        between = F.lit(False)
        for r in ranks:
            between = between | ((F.lit(True) if low[r][0] is None else after(value, key, low[r][0])) & (F.lit(True) if high[r][0] is None else ~after(value, key, high[r][0])))
        rows = sample(narrow.where(between))
        held = sorted((x[column], x["_k"]) for x in rows)
        if len(rows) <= bound:  # all there are
            return [[p for p in held if inside(p, r)][r - low[r][1] - 1] for r in ranks]


def ntile_bucket(row_no: Column, n: Column, tiles: int) -> Column:
    """SQL ``NTILE`` bucket of a row number: the first n mod k tiles get one row more."""
    small = F.floor(n / tiles)
    extra = n % tiles
    in_large = row_no <= extra * (small + 1)
    large_tile = F.floor((row_no - 1) / (small + 1)) + 1
    small_tile = extra + F.floor((row_no - 1 - extra * (small + 1)) / F.nullif(small, F.lit(0))) + 1
    return F.when(in_large, large_tile).otherwise(small_tile).cast("int")


def bounded_quantiles(column: Column | str, probs: Sequence[float]) -> Column:
    """Exact linear-interpolation quantiles for a measure with few distinct values.

    ``percentile`` keeps one counter per distinct value, which is bounded for
    whole days, counts and scores. Money columns go through ``exact_quantiles``.
    """
    return F.percentile(as_column(column).cast("double"), F.array(*[F.lit(float(p)) for p in probs]))


def exact_quantiles(
    df: DataFrame,
    column: Column | str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    alias: str = "quantiles",
    slack: float = 0.0002,
) -> DataFrame:
    """Exact linear-interpolation quantiles of an unbounded measure.

    Returns one row per group: ``by..., n, <alias> array<double>``. A sketch
    proposes two edges around every wanted quantile; the rows per cell between
    edges are counted exactly, and only the cells that hold a wanted rank are
    sorted. A poor sketch would make those cells larger, never the answer wrong.
    The input is read three times: pass a stored table, or ``materialize`` first
    what is expensive to recompute.
    """
    by = list(by)
    probs = [float(p) for p in probs]
    edge_probs = sorted({e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))})
    values = df.select(*by, as_column(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sketch_cols = [
        F.count("*").alias("n"),
        F.percentile_approx("_v", edge_probs, _SKETCH_ACCURACY).alias("_edges"),
    ]
    if by:
        sketch = values.groupBy(*by).agg(*sketch_cols)
        tagged = salted_join(values, sketch, by)
    else:
        summary = values.agg(*sketch_cols)
        tagged = values.withColumn("_s", summary.select(F.struct("n", "_edges")).scalar()).select(
            "_v", F.col("_s.n").alias("n"), F.col("_s._edges").alias("_edges")
        )
    cell = sum(((F.col("_v") > F.col("_edges")[i]).cast("int") for i in range(len(edge_probs))), F.lit(0))
    tagged = tagged.select(*by, "_v", "n", cell.alias("_cell"))

    positions = [F.lit(p) * (F.col("n") - 1) for p in probs]
    wanted = F.array_distinct(F.array(*[f(p).cast("bigint") for p in positions for f in (F.floor, F.ceil)]))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        tagged.groupBy(*by, "_cell").agg(F.count("*").alias("_rows"), F.first("n").alias("n"))
        .withColumn("_below", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_ranks", F.filter(
            wanted, lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_rows"))))
        .where(F.size("_ranks") > 0)
        .select(*by, "_cell", "_below", "_ranks")
    )
    # the wanted cells hold few rows; without groups there are at most 2*len(probs)+1 of them
    wanted_cells = cells.withColumnsRenamed({k: f"_want_{k}" for k in [*by, "_cell"]})
    condition = F.col("_cell") == F.col("_want__cell")
    for b in by:
        condition = condition & F.col(b).eqNullSafe(F.col(f"_want_{b}"))
    hits = tagged.join(wanted_cells if by else F.broadcast(wanted_cells), condition).drop(*[f"_want_{k}" for k in [*by, "_cell"]])
    in_cell = Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = (
        hits.groupBy(*by, "_cell", "_v")
        .agg(F.count("*").alias("_rows"), F.first("n").alias("n"),
             F.first("_below").alias("_below"), F.first("_ranks").alias("_ranks"))
        .withColumn("_upto", F.sum("_rows").over(in_cell) + F.col("_below"))
        .withColumn("_rank", F.explode(F.filter(
            "_ranks", lambda r: (r >= F.col("_upto") - F.col("_rows")) & (r < F.col("_upto")))))
    )
    found = picked.groupBy(*by).agg(
        F.first("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),
    )
    out = []
    for p in positions:
        low = F.element_at("_at", F.floor(p).cast("bigint"))
        high = F.element_at("_at", F.ceil(p).cast("bigint"))
        out.append(low + (high - low) * (p - F.floor(p)))
    return found.select(*by, "n", F.array(*out).alias(alias))
