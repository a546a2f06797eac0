"""Splits, pruning, winsorising and encoding of the assembled table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.schema import RESERVED, col, is_numeric

from .ranks import on, quantiles
from .select import stacked


@dataclass(frozen=True)
class Weeks:
    """The last week of training and of validation; later ones are for testing."""

    train_end: int = 69
    val_end: int = 74


def time_split(df: DataFrame, weeks: Weeks = Weeks(), week: str = "WEEK_NUM") -> dict[str, DataFrame]:
    w = col(week)
    return {"train": df.where(w <= weeks.train_end), "val": df.where((w > weeks.train_end) & (w <= weeks.val_end)), "test": df.where(w > weeks.val_end)}


def split_name(week: Column, weeks: Weeks = Weeks()) -> Column:
    return F.when(week <= weeks.train_end, "train").when(week <= weeks.val_end, "val").otherwise("test")


def expanding_folds(first: int, last: int, folds: int = 4, span: int = 4) -> list[tuple[int, int, int]]:
    """(train start, validation start, validation end) of each fold: consecutive spans that end with `last`; training
    takes all weeks before."""
    out = [(first, last - span * (folds - i) + 1, last - span * (folds - i - 1)) for i in range(folds)]
    return [f for f in out if f[1] > first]


def fold_frames(df: DataFrame, fold: tuple[int, int, int], week: str = "WEEK_NUM") -> tuple[DataFrame, DataFrame]:
    start, val, end = fold
    w = col(week)
    return df.where((w >= start) & (w < val)), df.where(w.between(val, end))


def inversions(df: DataFrame, position: str, column: str) -> DataFrame:
    """(n): at how many of the consecutive positions the column is less than at the one before. Neighbours meet by an
    equi-join on the position."""
    before = df.select((col(position) + 1).alias("__p"), col(column).alias("__v"))
    return df.select(col(position).alias("__p"), col(column).alias("__w")).join(before, "__p").agg(F.sum((F.col("__w") < F.col("__v")).cast("long")).alias("n"))


@dataclass(frozen=True)
class Pruner:
    """Fitted column pruning and winsorising."""

    drop: tuple[str, ...] = ()
    high: dict[str, float] = field(default_factory=dict)
    floor: tuple[str, ...] = ()

    @staticmethod
    def fit(df: DataFrame, null_rate: float = 0.97, most_levels: int = 5000, q: float = 0.998, skip: tuple[str, ...] = (*RESERVED, "target")) -> Pruner:
        """Columns that are nearly always null, constant, or strings of very many levels go; others that end in p or a
        get an upper bound at quantile q, those that end in o also 0 below (and 1 at least above). Columns of 0 and 1
        stay as they are. A column is constant if its least
        value is its greatest; only strings are counted by levels, and exact quantiles take a pass of their own."""
        names = [(n, t) for n, t in df.dtypes if n not in skip]
        shares = [e for i, (n, _) in enumerate(names) for e in (F.avg(col(n).isNull().cast("double")).alias(f"n{i}"), F.coalesce(F.min(col(n)) == F.max(col(n)), F.lit(True)).alias(f"c{i}"))]
        row = df.agg(*shares).first() if names else {}
        text = [n for n, t in names if t == "string"]
        levels = df.agg(*[F.count_distinct(col(n)).alias(f"d{i}") for i, n in enumerate(text)]).first() if text else {}
        many = {n for i, n in enumerate(text) if levels[f"d{i}"] > most_levels}
        drop = [n for i, (n, _) in enumerate(names) if (row[f"n{i}"] or 0) > null_rate or row[f"c{i}"] or n in many]
        ends = [n for n, t in names if n not in drop and is_numeric(t) and n.lower().endswith(("p", "a", "o"))]
        if not ends:
            return Pruner(tuple(drop))
        binary = [F.min(F.coalesce(col(n).isin(0, 1), F.lit(True))).alias(f"b{i}") for i, n in enumerate(ends)]
        row = df.agg(*binary).first()
        ends = [n for i, n in enumerate(ends) if not row[f"b{i}"]]
        found = {r.feature: r.q[0] for r in quantiles(stacked(df, ends), "x", [q], ["feature"]).collect()} if ends else {}  # a row a column
        kept = {n: found[n] for n in ends if n in found}
        floor = tuple(n for n in kept if n.lower().endswith("o"))
        return Pruner(tuple(drop), {n: max(1.0, h) if n in floor else h for n, h in kept.items()}, floor)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for n in df.columns:
            if n in self.drop:
                continue
            c = col(n)
            if n in self.high:
                cut = F.least(c, F.lit(self.high[n]))
                cut = F.greatest(F.lit(0.0), cut) if n in self.floor else cut
                c = F.when(c.isNotNull(), cut).alias(n)
            out.append(c)
        return df.select(*out)


def _running(rows: DataFrame, column: str, by: list[str], order: list[str], target: str) -> DataFrame:
    """rows with `__s` and `__c`: the sum and number of known targets of the same level in the rows before.

    Rows are sorted within (level, by) only; what the earlier ones of those hold is summed among their totals, so that a
    frequent level is spread over as many tasks as `by` has values.
    """
    y = col(target).cast("double")
    line = Window.partitionBy(col(column), *by).orderBy(*[col(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(col(column).alias("__level"), *[col(b).alias(f"__by{i}") for i, b in enumerate(by)]).agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("__ts"), F.count(y).alias("__tc"))
    before = Window.partitionBy("__level").orderBy(*[f"__by{i}" for i in range(len(by))]).rowsBetween(Window.unboundedPreceding, -1)  # a row for each value of `by`
    totals = totals.select("__level", *[f"__by{i}" for i in range(len(by))], F.coalesce(F.sum("__ts").over(before), F.lit(0.0)).alias("__bs"), F.coalesce(F.sum("__tc").over(before), F.lit(0)).alias("__bc"))
    keyed = totals.select(F.col("__level").alias(column), *[F.col(f"__by{i}").alias(b) for i, b in enumerate(by)], "__bs", "__bc")
    made = rows.withColumn("__is", F.coalesce(F.sum(y).over(line), F.lit(0.0))).withColumn("__ic", F.count(y).over(line))
    made = on(made, keyed, [column, *by])
    return made.withColumn("__s", F.col("__is") + F.col("__bs")).withColumn("__c", F.col("__ic") + F.col("__bc")).drop("__is", "__ic", "__bs", "__bc")


def encoder_state(history: DataFrame, column: str, order: list[str], target: str = "target", recent: int = 100) -> DataFrame:
    """(level, s, c, tail): what running_target_encode needs to know of a history, a row a level: the sum and number of
    its known targets, and the last `recent` of them in order. Small enough to keep, so the history is read once."""
    known = history.where(col(target).isNotNull())
    rows = _running(known, column, order[:1], order[1:] or order, target)
    whole = rows.groupBy(col(column).alias("__k")).agg(F.sum(col(target).cast("double")).alias("s"), F.count("*").alias("c"))
    near = on(rows.select(col(column).alias("__k"), F.col("__c").alias("at"), col(target).cast("double").alias("y")), whole, ["__k"]).where(F.col("at") >= F.col("c") - recent)
    tails = near.groupBy("__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "y"))), lambda t: t["y"]).alias("tail"))  # `recent` values a level
    return on(whole, tails, ["__k"], "left").select(F.col("__k").alias("level"), "s", "c", "tail")


def running_target_encode(
    current: DataFrame, history: DataFrame | None, column: str, order: list[str], target: str = "target", prior: float = 0.0,
    alpha: float = 100.0, beta: float = 10.0, least: int = 50, recent: int = 100, own: bool = False, state: DataFrame | None = None,
) -> DataFrame:
    """current with `<column>_te` and `<column>_trend`, from the targets of earlier rows of the same level.

    Earlier rows are all of `history`, then those of current before it by `order` (a total order). With `least` known
    targets the level's mean is smoothed towards `prior` with the weight alpha / (count + beta); `own` adds the row's own
    target to that. The trend is the mean of the `recent` last targets less the smoothed mean. Other rows get the prior
    and 0. Null targets never count and take no place among the recent ones. In place of a history a `state` that
    encoder_state() made of one can be given.

    Running sums go by level and the order's first column (see _running); the sum of the `recent` last targets is the
    running sum less the one `recent` targets earlier, found by an equi-join on the level and the count.
    """
    y = col(target).cast("double")
    rows, by = current.withColumn("__seg", F.lit(1)), order[:1]
    if history is not None and state is None:
        rows, by = rows.unionByName(history.withColumn("__seg", F.lit(0)), allowMissingColumns=True), ["__seg", *by]
    rows = _running(rows, column, by, order[1:] or order, target)
    past = rows.where(y.isNotNull()).select(col(column).alias("__pk"), (F.col("__c") + 1).alias("__pc"), (F.col("__s") + y).alias("__ps"))
    rows = rows.where("__seg = 1").join(past, col(column).eqNullSafe(F.col("__pk")) & (F.col("__c") - recent == F.col("__pc")), "left")
    s0, c0, tail = F.lit(0.0), F.lit(0).cast("long"), F.lit(0.0)
    if state is not None:
        rows = rows.join(state.select(F.col("level").alias("__sk"), F.col("s").alias("__s0"), F.col("c").alias("__c0"), F.col("tail").alias("__tail")), col(column).eqNullSafe(F.col("__sk")), "left")
        s0, c0 = F.coalesce("__s0", F.lit(0.0)), F.coalesce("__c0", F.lit(0).cast("long"))
        older = F.greatest(F.lit(0), recent - F.col("__c")).cast("int")  # how many of the recent ones the state holds
        held = F.coalesce("__tail", F.array().cast("array<double>"))
        use = F.least(older, F.size(held))
        tail = F.when(use > 0, F.aggregate(F.slice(held, F.size(held) - use + 1, F.greatest(use, F.lit(1))), F.lit(0.0), lambda a, v: a + v)).otherwise(0.0)
    count = F.col("__c") + c0
    recent_sum = F.col("__s") - F.coalesce("__ps", F.lit(0.0)) + tail
    late = F.when(count > 0, recent_sum / F.least(count, F.lit(recent)))
    w = F.lit(alpha) / (count + F.lit(beta))
    mine = y.isNotNull() if own else F.lit(False)
    total, n = F.col("__s") + s0 + F.when(mine, y).otherwise(0.0), count + F.when(mine, 1).otherwise(0)
    mean = F.when(count >= least, (total + F.lit(prior) * w) / (n + w)).otherwise(F.lit(prior))
    trend = F.when((count >= least) & late.isNotNull(), late - mean).otherwise(F.lit(0.0))
    return rows.select(*[col(n) for n in current.columns], mean.alias(f"{column}_te"), trend.alias(f"{column}_trend"))


@dataclass(frozen=True)
class Encoder:
    """Fitted encoding: the global mean, the levels of each one-hot column, and the columns for running encoding."""

    mean: float
    levels: dict[str, tuple[str, ...]]
    running: tuple[str, ...]

    @staticmethod
    def fit(df: DataFrame, target: str = "target", most: int = 20, skip: tuple[str, ...] = (*RESERVED, "target")) -> Encoder:
        text = [n for n, t in df.dtypes if t == "string" and n not in skip]
        row = df.agg(F.avg(col(target)).alias("m"), *[F.count_distinct(col(n)).alias(f"d{i}") for i, n in enumerate(text)]).first()
        low = [n for i, n in enumerate(text) if row[f"d{i}"] <= most]  # at most `most` levels each, so they are small
        levels = {n: tuple(sorted(r[0] for r in df.where(col(n).isNotNull()).select(col(n)).distinct().collect())) for n in low}
        return Encoder(float(row.m or 0.0), levels, tuple(n for n in text if n not in low))

    def one_hot(self, df: DataFrame) -> DataFrame:
        """A 0/1 column for each level but the first, as frozen at fit; null and unseen levels are 0 in all."""
        out = [col(n) for n in df.columns if n not in self.levels]
        out += [F.coalesce((col(n) == v).cast("int"), F.lit(0)).alias(f"{n}_{v}") for n in self.levels for v in self.levels[n][1:]]
        return df.select(*out)

    def states(self, history: DataFrame, order: list[str], target: str = "target") -> dict[str, DataFrame]:
        """What transform() needs of a history, by column; can be written and read again."""
        return {n: encoder_state(history, n, order, target) for n in self.running}

    def transform(self, current: DataFrame, history: DataFrame | None, order: list[str], target: str = "target", states: dict[str, DataFrame] | None = None) -> DataFrame:
        """One-hot columns, and each high-cardinality column replaced by its running encoding and trend. The rows before
        are those of a history, or what states() has kept of it."""
        out = current
        for n in self.running:
            made = running_target_encode(out, history, n, order, target, self.mean, state=(states or {}).get(n))
            out = made.select(*[(col(f"{n}_te").alias(n) if c == n else col(c)) for c in out.columns], col(f"{n}_trend"))
        return self.one_hot(out)
