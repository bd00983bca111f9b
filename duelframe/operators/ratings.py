"""Batch-updated ratings of entities.

All contests of a period see the ratings from before the period. Every (target, alpha) pair is a `cell`; all cells of an
entity are one array, so a grid shares one pass and multiplies no rows.

A round takes a window of consecutive periods. Entities that no contest of the window connects do not depend on each
other, so the connected components of its contests go to tasks, and a task walks through the periods of its components
with arrays. A window is as long as its largest component is small (`WINDOW_VALUES` ratings): with sparse contests, years
go in one round on many tasks. A single period that is still too large depends on nothing within itself; its rows are
split over tasks and their moves summed by entity. The state is a written table of one row an entity, replaced after each
window, so a lost executor costs one window at most, and no plan grows with the number of windows.

Contests that are all connected are walked by one task after another, so a task gets and gives as little as it can: it
reads numbered rows, which were sorted by many tasks, and writes ratings once an entity and period; the contest rows
look them up, again in many tasks.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.dates import week_bucket
from ..functions.odds import expit, logit
from ..functions.text import _c
from ..keys import Keys
from ..session import BROADCAST_ROWS, discard, materialize
from .aggs import group_stddev, pooled_rate_logit_of
from .graphs import connected
from .protocols import BINARY, BINARY_OFFSET, REAL, expit_of, half_step, rating_hook
from .sums import matrix, summed, unpack, upper

# Contest rows times cells that one task holds.
WINDOW_VALUES = 4_000_000
# Cells that count for the rows a task holds: rows by more cells are held in steps.
HELD_CELLS = 8
# A window of a dense graph is as large as one task holds; so often a larger one is tried.
TRIED = 8
RATED = ["pred", "side_before", "opp_before", "side_after", "opp_after"]
HISTORY = ["period", "entity", "before", "after"]
HISTORY_SCHEMA = "period string, entity string, before array<double>, after array<double>"

# Functions sent to executors carry their code.
cloudpickle.register_pickle_by_value(sys.modules["duelframe.operators"])


@dataclass
class RatingResult:
    """`features`: one row per contest row and cell; `state`: (cell, entity, rating) after the last period; `rated`: one row
    per contest row with an array of all cells, in the order of the grid; `windows`: the rounds that were walked."""
    features: DataFrame
    state: DataFrame
    history: DataFrame
    rated: DataFrame = None
    windows: int = 0


def period_of(date, period):
    """Only `date` gives every contest the ratings of the day before; coarser periods are faster and coarser."""
    if period == "date":
        return F.date_format(date, "yyyy-MM-dd")
    if period == "week":
        return F.date_format(week_bucket(date), "yyyy-MM-dd")
    if period in ("month", "quarter", "year"):
        return F.date_format(F.date_trunc(period, date), "yyyy-MM-dd")
    raise ValueError(f"unknown period {period!r}")


def _grid(targets, alphas):
    """[(cell, target, alpha)]; `alphas` is one number, a list for every target, or {target: number or list}."""
    out = []
    for target in targets:
        values = alphas[target] if isinstance(alphas, dict) else alphas
        many = isinstance(values, (list, tuple))
        for alpha in values if many else [values]:
            out.append((f"{target}@{alpha}" if many else target, target, float(alpha)))
    return out


# -- in tasks ---------------------------------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    """A column of equally long lists as rows by cells; null is NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(matrix: np.ndarray):
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    flat = np.ascontiguousarray(matrix).ravel()
    return pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat)))


def _codes(columns, names) -> list:
    """Entities as numbers into `names`; null is the last, which no one is."""
    out = []
    for c in columns:
        found = pc.fill_null(pc.index_in(c, value_set=names), len(names)).to_numpy(zero_copy_only=False)
        out.append(np.asarray(found, np.int64))
    return out


def _add(ratings, at, moves):
    """Adds rows of moves to the rows of ratings that they name, which may repeat."""
    n = ratings.shape[1]
    np.add.at(ratings.reshape(-1), (at[:, None] * n + np.arange(n)).ravel(), moves.ravel())


def _walk(hook, given, alphas, limit, of):
    """Rows sorted by component: state rows (no period; e_side is the entity, y its ratings) and contest rows.
    Whole components, as many as `limit` rows allow, are walked through together, period by
    period, the rows of a period in the order of their numbers `n`. Cell k has the target `of[k]` of y. Out come the
    entities of every period, then states without a period."""
    alphas = np.asarray(alphas, float)
    step = max(1, WINDOW_VALUES // len(alphas))

    def walked(table):
        is_state = pc.is_null(table.column("period"))
        state, rows = table.filter(is_state), table.filter(pc.invert(is_state))
        everyone = pa.chunked_array([*rows.column("e_side").chunks, *rows.column("e_opp").chunks, *state.column("e_side").chunks], pa.string())
        names = pc.drop_null(pc.unique(everyone))
        side, opp, known = _codes([rows.column("e_side"), rows.column("e_opp"), state.column("e_side")], names)
        periods = pc.unique(rows.column("period")).sort()
        period = pc.index_in(rows.column("period"), value_set=periods).to_numpy()
        order = np.lexsort((rows.column("n").to_numpy(), period))
        begins = np.append(np.searchsorted(period[order], np.arange(len(periods))), len(rows))
        ratings = np.zeros((len(names) + 1, len(alphas)))
        ratings[known] = _matrix(state.column("y")) if len(known) else 0
        y, off = _matrix(rows.column("y")), _matrix(rows.column("off"))
        for n, (a, b) in enumerate(zip(begins[:-1], begins[1:])):
            at = order[a:b]
            s, o = side[at], opp[at]
            here, own = np.unique(np.append(s, o), return_inverse=True)
            first, after = ratings[here], ratings[here]
            for k in range(0, len(at), step):  # rows by cells are held for one step only
                part = at[k:k + step]
                move = hook.delta(y[part][:, of], hook.predict(ratings[s[k:k + step]], ratings[o[k:k + step]], given(off[part])), alphas)
                _add(after, own[:len(at)][k:k + step], move)
                _add(after, own[len(at):][k:k + step], -move)
            ratings[here] = after
            ratings[-1] = 0
            found = here < len(names)
            here, first = here[found], first[found]
            for k in range(0, len(here), 10_000):
                part = slice(k, k + 10_000)
                yield pa.RecordBatch.from_arrays([pa.repeat(periods[n], len(here[part])), names.take(pa.array(here[part])), _lists(first[part]), _lists(ratings[here[part]])], names=HISTORY)
        ends = _lists(ratings[:-1])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.string()), names, pa.nulls(len(names), ends.type), ends], names=HISTORY)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= limit:
                table = pa.concat_tables(held)
                inside = pc.not_equal(table.column("component"), table.column("component")[-1]).to_numpy()
                cut = int(inside.sum())  # sorted: all but the last component, which may go on
                if cut:
                    yield from walked(table.slice(0, cut))
                held = [table.slice(cut)]
                size = len(held[0])
        if held:
            yield from walked(pa.concat_tables(held))
    return run


def _apart(hook, given, alphas, of):
    """Rows of one period with both ratings before it: the prediction and the row's move, in batches of any size."""
    alphas = np.asarray(alphas, float)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                side, opp, y = (_matrix(batch.column(c)) for c in ("side_before", "opp_before", "y"))
                pred = hook.predict(side, opp, given(_matrix(batch.column("off"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(pred), _lists(hook.delta(y[:, of], pred, alphas))], names=[*batch.schema.names, "pred", "move"])
    return run


# -- windows of periods -----------------------------------------------------------------------------

def _plus(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def _zeros(n):
    return F.array_repeat(F.lit(0.0), n)


class _Walker:
    def __init__(self, rows: DataFrame, hook, given, alphas, of, state, ends=None):
        self.spark, self.hook, self.given, self.alphas, self.of = rows.sparkSession, hook, given, alphas, list(of)
        self.rows = materialize(rows, "contests")
        if ends:
            self.rows = self.rows.withColumns({"e_side": ends[0], "e_opp": ends[1]})
        self.limit = max(1, WINDOW_VALUES // min(len(alphas), HELD_CELLS))
        self.state = materialize(state, "state")
        self.written, self.windows = [], 0

    def run(self):
        counts = self.rows.groupBy("period").count().orderBy("period").collect()  # bounded by the calendar
        if not counts:
            return self
        # All periods in one window need no order among the files: a hash stands for contest and side.
        total, every = sum(c["count"] for c in counts), self.rows.select(F.xxhash64("contest", "e_side", "e_opp").alias("n"), "period", "e_side", "e_opp", "y", "off")
        placed, largest = self._placed(every, total)
        if placed is None and len(counts) > 1:
            return self._by_windows(counts, self._smaller(total, largest))
        self._advance(*(self._one_period(every, counts[0].period) if placed is None else self._window(every, *placed)))
        return self

    def _smaller(self, size, largest):
        return max(1, min(size // 2, max(self.limit, size * self.limit // largest)))

    def _by_windows(self, counts, most):
        # Sorted files: a window reads its own. Rising numbers stand for the order of contest and side.
        order = [F.asc_nulls_last(c) for c in ("period", "contest", "e_side")]
        sorted_ = self.rows.select("period", "contest", "e_side", "e_opp", "y", "off").repartitionByRange(*order).sortWithinPartitions(*order)
        sorted_ = materialize(sorted_.select(F.monotonically_increasing_id().alias("n"), "period", "e_side", "e_opp", "y", "off"), "sorted")
        at = 0
        while at < len(counts):
            end, size = at, 0
            while end < len(counts) and (end == at or size + counts[end]["count"] <= most):
                size += counts[end]["count"]
                end += 1
            window = sorted_.where(F.col("period").between(counts[at].period, counts[end - 1].period))
            placed, largest = self._placed(window, size)
            if placed is None and end - at > 1:
                most = self._smaller(size, largest)
                continue
            self._advance(*(self._one_period(window, counts[at].period) if placed is None else self._window(window, *placed)))
            at = end
            # What was too large once is tried again only slowly: up to one task's rows nothing has to be tried.
            if most < self.limit or most > 2 * self.limit or self.windows % TRIED == 0:
                most = max(most + most // 8, min(2 * most, self.limit))
        discard(sorted_)
        return self

    def _placed(self, window, size):
        """((entities with their component, number of tasks), rows of the largest); the first is None where that is too large
        for a task."""
        ends = [F.coalesce("e_side", "e_opp").alias("node"), F.coalesce("e_opp", "e_side").alias("other")]
        if size <= self.limit:
            entities = window.select(F.explode(F.array("e_side", "e_opp")).alias("node")).where("node is not null").distinct()
            return (entities.withColumn("component", F.lit("")), 1), size
        parts = connected(window.select(*ends), "node", "other")
        rows = window.select(ends[0]).groupBy("node").count().join(parts, "node").groupBy("component").agg(F.sum("count").alias("count"))
        largest = rows.agg(F.max("count")).first()[0] or 0
        if largest > self.limit:
            return None, largest
        return (F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts, None), largest

    def _window(self, window, placed, tasks):
        node = F.col("node")
        if tasks == 1:
            found = window.withColumn("component", F.lit(""))
        else:
            found = window.join(placed, F.coalesce("e_side", "e_opp") == node).drop("node")  # rows of no entity move nothing
        before = self.state.join(placed, self.state["entity"] == node).select(F.col("entity").alias("e_side"), F.col("ratings").alias("y"), "component")
        both = found.unionByName(before, allowMissingColumns=True)
        n = tasks or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = both.repartition(n, "component")
        walk = _walk(self.hook, self.given, self.alphas, self.limit, self.of)
        dealt = dealt if tasks == 1 else dealt.sortWithinPartitions("component")
        done = materialize(dealt.mapInArrow(walk, HISTORY_SCHEMA), "history")
        return done.where("period is not null"), done.where("period is null").select("entity", F.col("after").alias("ratings"))

    def _one_period(self, window, period):
        n = len(self.alphas)
        state = self.state.select(F.col("entity").alias("_e"), "ratings")
        for side in ("side", "opp"):
            window = window.join(state, F.col(f"e_{side}") == F.col("_e"), "left")
            window = window.withColumn(f"{side}_before", F.coalesce("ratings", _zeros(n))).drop("_e", "ratings")
        fields = [StructField(f.name, f.dataType) for f in window.schema.fields] + [StructField(c, ArrayType(DoubleType())) for c in ("pred", "move")]
        moved = materialize(window.mapInArrow(_apart(self.hook, self.given, self.alphas, self.of), StructType(fields)), "moves")
        back = F.transform("move", lambda x: -x)
        sides = moved.select(F.explode(F.array(F.struct(F.col("e_side").alias("entity"), "move"), F.struct(F.col("e_opp").alias("entity"), back.alias("move")))).alias("m"))
        cells = sides.select("m.entity", F.posexplode("m.move").alias("k", "v")).where("entity is not null").groupBy("entity", "k").agg(F.sum("v").alias("v"))
        total = cells.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("change"))
        before = F.coalesce("ratings", _zeros(n))
        after = total.join(self.state, "entity", "left").select("entity", before.alias("before"), _plus(before, F.col("change")).alias("ratings"))
        after = materialize(after, "state-moved")
        return after.select(F.lit(period).alias("period"), "entity", "before", F.col("ratings").alias("after")), after

    def _advance(self, rows, after):
        self.written.append(rows)
        self.windows += 1
        before, rest = self.state, self.state.join(after.select("entity"), "entity", "left_anti")
        self.state = materialize(rest.unionByName(after.select("entity", "ratings")), "state")
        discard(before)


def _state_arrays(spark, state, cells):
    """(entity, ratings) of a long (cell, entity, rating) state."""
    if state is None:
        return spark.createDataFrame([], "entity string, ratings array<double>")
    by = F.map_from_entries(F.collect_list(F.struct("cell", "rating")))
    held = state.where(F.col("cell").isin(cells)).groupBy(F.col("entity").cast("string").alias("entity")).agg(by.alias("m"))
    return held.select("entity", F.array(*[F.coalesce(F.element_at("m", F.lit(c)), F.lit(0.0)) for c in cells]).alias("ratings"))


def rate_arrays(rows: DataFrame, keys: Keys, hook, cells, alphas, of, given=lambda off: off, state=None, given_at=lambda off, k: F.get(off, F.lit(0)), ends=None) -> tuple:
    """(rated rows, entities, windows, history): `rows` has keys.all, period, e_side, e_opp and the arrays y and
    off; cell k has the target `of[k]` of y, so that a target of many cells is there once. Rated rows have y by cell and
    the arrays of RATED, entities are (entity, ratings). `given` makes of off's rows what the hook takes, `given_at` of the
    column what it takes for one cell. `ends` are e_side and e_opp as expressions of the keys, where `rows` lacks them: they
    are neither written nor moved beside the keys."""
    spark = rows.sparkSession
    plain = rows.withColumnRenamed(keys.contest, "contest").where("period is not null")
    walker = _Walker(plain, hook, given, alphas, of, _state_arrays(spark, state, cells), ends).run()
    by_cell = F.array(*[F.get("y", F.lit(k)) for k in of])
    if not walker.written:
        empty = walker.rows.withColumn("y", by_cell).select("*", *[F.lit(None).cast("array<double>").alias(c) for c in RATED])
        return empty.withColumnRenamed("contest", keys.contest), walker.state, 0, None
    written = walker.written[0]
    for more in walker.written[1:]:
        written = written.unionByName(more)
    rated = _looked_up(walker.rows, written, hook, len(cells), given_at, ends or (F.col("e_side"), F.col("e_opp")))
    return rated.withColumn("y", by_cell).withColumnRenamed("contest", keys.contest), walker.state, walker.windows, written


def _looked_up(rows, history, hook, n, given_at, ends):
    """Contest rows with the ratings of both entities in their period. Ratings are looked up as a column a cell, and the
    prediction is an array of one expression a cell: Spark moves and computes those that are asked for."""
    columns, values = rows.columns, {}
    for side, end in zip(("side", "opp"), ends):
        cells = {f"_{side}_{at}_{k}": F.get(at, F.lit(k)) for at in ("before", "after") for k in range(n)}
        own = history.select(F.col("period").alias("_p"), F.col("entity").alias("_e"), *[v.alias(c) for c, v in cells.items()])
        rows = rows.join(own, (F.col("period") == F.col("_p")) & (end == F.col("_e")), "left").drop("_p", "_e")
        values |= {c: F.coalesce(c, F.lit(0.0)) for c in cells}
    at = lambda side, k: values[f"_{side}_before_{k}"]
    pred = F.array(*[F.nullif(hook.predict(at("side", k), at("opp", k), given_at(F.col("off"), k)), F.lit(float("nan"))) for k in range(n)])
    arrays = [F.array(*[values[f"_{c}_{k}"] for k in range(n)]).alias(c) for c in RATED[1:]]
    return rows.select(*columns, pred.alias(RATED[0]), *arrays)


def _long(rated, cells, *columns, **constants):
    """A row for each cell of every rated row; one cell's row is there."""
    if len(cells) == 1:
        own = [F.lit(cells[0]).alias("cell"), *[F.lit(v[0]).alias(c) for c, v in constants.items()], *[F.get(c, F.lit(0)).alias(c) for c in columns]]
        return F.struct(*own).alias("z")
    lists = [F.array(*map(F.lit, cells)).alias("cell"), *[F.array(*map(F.lit, v)).alias(c) for c, v in constants.items()], *[F.col(c) for c in columns]]
    return F.explode(F.arrays_zip(*lists)).alias("z")


def _result(rated, entities, keys, cells, windows, seen, features):
    ends = F.array(
        F.struct(F.col("e_side").alias("entity"), F.col("side_before").alias("before"), F.col("side_after").alias("after")),
        F.struct(F.col("e_opp").alias("entity"), F.col("opp_before").alias("before"), F.col("opp_after").alias("after")))
    if seen is None:
        # All rows of an entity and period have the same ratings.
        seen = rated.select("period", F.explode(ends).alias("m")).select("period", "m.*").where("entity is not null")
        seen = seen.groupBy("entity", "period").agg(F.min("before").alias("before"), F.min("after").alias("after"))
    history = seen.select("period", "entity", _long(seen, cells, "before", "after")).select("z.cell", "period", "entity", "z.before", "z.after")
    state = entities.select("entity", F.explode(F.arrays_zip(F.array(*map(F.lit, cells)).alias("cell"), "ratings")).alias("z")).select("z.cell", "entity", F.col("z.ratings").alias("rating"))
    return RatingResult(features, state, history, rated, windows)


def rate(df: DataFrame, keys: Keys, targets, alphas, hook, period="date", state=None, offset=None) -> RatingResult:
    """Ratings by any hook over a doubled table. Rows of a null entity take part with rating 0 and learn nothing; a null
    or NaN target moves nothing; rows without a date are left out."""
    grid = _grid(targets, alphas)
    cells = [c for c, _, _ in grid]
    names = list(dict.fromkeys(t for _, t, _ in grid))
    offset_col = F.lit(0.0) if offset is None else _c(offset).cast("double")
    rows = df.select(
        *keys.all, period_of(F.col(keys.date), period).alias("period"), F.array(*[F.col(t).cast("double") for t in names]).alias("y"), F.array(offset_col).alias("off"))
    ends = F.col(keys.side).cast("string"), F.col(keys.opp).cast("string")
    rated, entities, windows, seen = rate_arrays(rows, keys, hook, cells, [a for _, _, a in grid], [names.index(t) for _, t, _ in grid], state=state, ends=ends)
    features = rated.select(*keys.all, _long(rated, cells, "y", *RATED)).select(*keys.all, "z.cell", "z.y", *[f"z.{c}" for c in RATED])
    return _result(rated, entities, keys, cells, windows, seen, features)


def rating_real(df, keys=Keys(), targets=(), alphas=0.5, period="date", state=None) -> RatingResult:
    return rate(df, keys, targets, alphas, REAL, period, state)


def rating_binary(df, keys=Keys(), targets=(), alphas=0.5, period="date", state=None) -> RatingResult:
    return rate(df, keys, targets, alphas, BINARY, period, state)


def rating_binary_offset(df, keys=Keys(), targets=(), alphas=0.5, offset="offset", period="date", state=None) -> RatingResult:
    """Ratings of what the market gets wrong: `offset` is the market's log odds for the side."""
    return rate(df, keys, targets, alphas, BINARY_OFFSET, period, state, offset)


# `offset` holds attempted and intercept, y the landed count; the step is 0.5 * alpha * (landed - attempted * p).
ACCURACY = rating_hook(lambda off, dfn, given: given["attempted"] * expit_of(off - dfn + given["intercept"]), half_step)


def rating_accuracy(df: DataFrame, keys=Keys(), pairs=None, alphas=0.5, period="date") -> RatingResult:
    """Offence and defence ratings from landed/attempted counts of a doubled table; `pairs` = {name: (landed, attempted)}.

    Contests of a period are updated as one batch and the pooled-rate intercept is part of every prediction;
    an unobserved row moves nothing, so its ratings are the last known ones. All pairs share one scan for their
    intercepts and one pass.
    """
    sums = df.agg(*[pooled_rate_logit_of([landed], [attempted]).alias(name) for name, (landed, attempted) in pairs.items()]).first()
    grid, ys, offs = [], [], []
    for at, (name, (landed, attempted)) in enumerate(pairs.items()):
        seen = F.col(landed).isNotNull() & F.col(attempted).isNotNull()
        ys.append(F.when(seen, F.col(landed)).cast("double"))
        offs.append(F.when(seen, F.col(attempted)).cast("double"))
        grid += [(cell, alpha, sums[name], at) for cell, _, alpha in _grid([name], alphas)]
    cells, steps, intercepts, of = (list(x) for x in zip(*grid))
    shift = np.array([[np.nan if b is None else b for b in intercepts]])
    rows = df.select(*keys.all, period_of(F.col(keys.date), period).alias("period"), F.array(*ys).alias("y"), F.array(*offs).alias("off"))
    ends = F.concat(F.lit("off|"), F.col(keys.side).cast("string")), F.concat(F.lit("def|"), F.col(keys.opp).cast("string"))
    at = lambda off, k: {"attempted": F.get(off, F.lit(of[k])), "intercept": F.lit(intercepts[k]).cast("double")}
    rated, entities, windows, seen = rate_arrays(rows, keys, ACCURACY, cells, steps, of, lambda off: {"attempted": off[:, of], "intercept": shift}, given_at=at, ends=ends)
    p_hat = [expit(F.get("side_before", F.lit(k)) - F.get("opp_before", F.lit(k)) + F.lit(b).cast("double")) for k, b in enumerate(intercepts)]
    rated = rated.withColumns({"off": F.array(*[F.get("off", F.lit(k)) for k in of]), "p_hat": F.array(*p_hat)})
    z = rated.select(*keys.all, _long(rated, cells, "y", "off", *RATED, intercept=intercepts))
    features = z.select(
        *keys.all, "z.cell", F.col("z.y").alias("landed"), F.col("z.off").alias("attempted"),
        expit(F.col("z.side_before") - F.col("z.opp_before") + F.col("z.intercept")).alias("p_hat"),
        F.col("z.side_before").alias("off_before"), F.col("z.opp_before").alias("opp_def_before"),
        F.col("z.side_after").alias("off_after"), F.col("z.opp_after").alias("opp_def_after"))
    return _result(rated, entities, keys, cells, windows, seen, features)


def accuracy_features(result: RatingResult, keys: Keys = Keys()) -> DataFrame:
    """Difference of the two sides' expected accuracies, plain and on the logit scale; both rows of a contest meet in one
    aggregate. A contest with one row has nothing to compare."""
    row = F.struct(F.col(keys.side).alias("side"), F.col(keys.opp).alias("opp"), "p_hat")
    both = result.features.groupBy(keys.contest, "cell").agg(F.min(row).alias("a"), F.max(row).alias("b"))
    paired = (F.col("a.side") == F.col("b.opp")) & (F.col("a.opp") == F.col("b.side"))
    pair = lambda x, y: F.struct(F.col(f"{x}.side").alias(keys.side), F.col(f"{x}.opp").alias(keys.opp), F.col(f"{x}.p_hat").alias("p_hat"),
                                 F.when(paired, F.col(f"{y}.p_hat")).alias("p_hat_opp"))
    rows = both.select(keys.contest, "cell", F.explode(F.when(F.col("a") == F.col("b"), F.array(pair("a", "b"))).otherwise(F.array(pair("a", "b"), pair("b", "a")))).alias("r"))
    return rows.select(keys.contest, "r." + keys.side, "r." + keys.opp, "cell", "r.p_hat", "r.p_hat_opp").withColumns({
        "p_diff": F.col("p_hat") - F.col("p_hat_opp"), "logit_diff": logit("p_hat") - logit("p_hat_opp")})


def accuracy_features_wide(result: RatingResult, cells, keys: Keys = Keys()) -> DataFrame:
    """The same in a row a contest and side, with columns `p_diff_<k>` and `logit_diff_<k>` for the k-th of the result's cells:
    a contest's rows meet once for all cells. Rows of a contest that name one side twice are one, with the greatest difference."""
    numbers = range(len(cells))
    row = lambda k: F.struct(F.col(keys.side).alias("side"), F.col(keys.opp).alias("opp"), F.get("p_hat", F.lit(k)).alias("p"))
    both = result.rated.groupBy(keys.contest).agg(*[f(row(k)).alias(f"{name}{k}") for k in numbers for f, name in ((F.min, "a"), (F.max, "b"))])
    paired = (F.col("a0.side") == F.col("b0.opp")) & (F.col("a0.opp") == F.col("b0.side"))
    one = F.col("a0.side").eqNullSafe(F.col("b0.side")) & F.col("a0.opp").eqNullSafe(F.col("b0.opp"))
    diffs = lambda x, y: [d for k in numbers for d in (
        F.when(paired, F.col(f"{x}{k}.p") - F.col(f"{y}{k}.p")), F.when(paired, logit(F.col(f"{x}{k}.p")) - logit(F.col(f"{y}{k}.p"))))]
    names = [f"{name}_{k}" for k in numbers for name in ("p_diff", "logit_diff")]
    pair = lambda x, ds: F.struct(F.col(f"{x}0.side").alias(keys.side), F.col(f"{x}0.opp").alias(keys.opp), *[d.alias(c) for d, c in zip(ds, names)])
    ab, ba = diffs("a", "b"), diffs("b", "a")
    rows = F.when(one, F.array(pair("a", [F.greatest(x, y) for x, y in zip(ab, ba)]))).otherwise(F.array(pair("a", ab), pair("b", ba)))
    return both.select(keys.contest, F.explode(rows).alias("r")).select(keys.contest, "r.*")


def rating_predict(df: DataFrame, state: DataFrame, keys: Keys = Keys(), hook=REAL, offset=None) -> DataFrame:
    """Final ratings applied to new contests without an update; unknown entities have rating 0."""
    cells = [r[0] for r in state.select("cell").distinct().collect()]  # as many as the grid has
    rows = df.withColumn("cell", F.explode(F.array(*[F.lit(c) for c in cells]).cast("array<string>")))
    side = state.select("cell", F.col("entity").alias("_e"), F.col("rating").alias("side_rating"))
    opp = state.select("cell", F.col("entity").alias("_e"), F.col("rating").alias("opp_rating"))
    out = rows.withColumn("_e", F.col(keys.side).cast("string")).join(side, ["cell", "_e"], "left").drop("_e")
    out = out.withColumn("_e", F.col(keys.opp).cast("string")).join(opp, ["cell", "_e"], "left").drop("_e")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("side_rating", "opp_rating")})
    off = F.lit(0.0) if offset is None else _c(offset)
    return out.withColumn("pred", hook.predict(F.col("side_rating"), F.col("opp_rating"), off))


def rating_multi(df: DataFrame, keys: Keys, alphas: dict, kind="real", period="date", test: DataFrame = None) -> DataFrame:
    """One wide row per contest row with pred/side/opp/updated columns per target; with `test`, predictions only."""
    hook = {"real": REAL, "binary": BINARY}[kind]
    result = rate(df, keys, list(alphas), alphas, hook, period)
    cells = [c for c, _, _ in _grid(list(alphas), alphas)]
    if test is not None:
        long_rows = rating_predict(test.select(*keys.all), result.state, keys, hook)
        return long_rows.groupBy(*keys.all).agg(*[F.max(F.when(F.col("cell") == c, F.col("pred"))).alias(f"pred_{c}") for c in cells])
    picks = [("pred", "pred"), ("side", "side_before"), ("opp", "opp_before"), ("updated_side", "side_after"), ("updated_opp", "opp_after")]
    return result.rated.select(*keys.all, *[F.get(col, F.lit(k)).alias(f"{name}_{c}") for k, c in enumerate(cells) for name, col in picks])


def rating_history(result: RatingResult, entity) -> DataFrame:
    """Ratings of one entity after each period it took part in; `n` counts from 0 within a cell."""
    from pyspark.sql import Window

    # One row per period of the calendar, so the window is small.
    w = Window.partitionBy("cell").orderBy("period")
    rows = result.history.where(F.col("entity") == str(entity))
    return rows.select("cell", "entity", "period", (F.row_number().over(w) - 1).alias("n"), F.col("after").alias("rating"))


def pca_components(df: DataFrame, cols, k, by=None) -> DataFrame:
    """Whitened principal components pc_0.. of scaled columns; rows with a null column get null components.

    The covariance is one packed sum over the table; only that d x d matrix is decomposed on the driver. The sign
    of a component is fixed so that its largest loading, the last of those that are equal but for rounding, is positive.
    """
    cols = list(cols)
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    only = df.withColumns({f"_x_{c}": F.when(complete, F.col(c)) for c in cols})
    scaled = group_stddev(only, [f"_x_{c}" for c in cols], by)
    xs = [f"_x_{c}_scaled" for c in cols]
    d = len(cols)
    mean = np.array(scaled.agg(*[F.avg(x) for x in xs]).first(), dtype=float)
    known = scaled.where(F.col(xs[0]).isNotNull()).select(F.array(*xs).alias("x"))

    def scatter(batch):
        x = matrix(batch.column(0)) - mean
        return {0: np.append((x.T @ x)[upper(d)], len(x))}

    sums = summed(known, scatter).get(0, np.zeros(d * (d + 1) // 2 + 1))
    cov = unpack(sums[:-1], d) / max(sums[-1] - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    out = scaled
    for rank, at in enumerate(order):
        v = vectors[:, at]
        largest = np.nonzero(np.abs(v) > np.abs(v).max() * (1 - 1e-9))[0][-1]
        v = v * np.sign(v[largest]) / np.sqrt(max(values[at], 1e-300))
        term = F.lit(0.0)
        for x, m, weight in zip(xs, mean, v):
            term = term + (F.col(x) - F.lit(float(m))) * F.lit(float(weight))
        out = out.withColumn(f"pc_{rank}", term)
    return out.select(*df.columns, *[f"pc_{i}" for i in range(min(k, d))])


def pca_rating(df: DataFrame, keys: Keys, cols, k, alpha, by=None, period="date") -> RatingResult:
    """R1 on each whitened component; rows without all columns move nothing."""
    groups = [] if by is None else [by] if isinstance(by, str) else list(by)
    parts = pca_components(df.select(*dict.fromkeys([*keys.all, *cols, *groups])), cols, k, by)  # they are written
    return rating_real(parts, keys, [f"pc_{i}" for i in range(min(k, len(cols)))], alpha, period)
