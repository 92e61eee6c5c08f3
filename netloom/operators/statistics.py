"""Set-based statistics: ranks, percentiles, AUC, KS, Jensen-Shannon distances, confusion metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Cells an octave of values is cut in by ``cell``, and what lies above the cells of all doubles below 1.
FINE, ABOVE = 4096, 1200


def cell(value: Column) -> Column:
    """A whole number that never falls where the value grows: by the value's logarithm, the sign apart.

    It depends on the value alone, so rows can be dealt by it without a look at the data.
    """
    size = F.floor((F.log2(F.abs(value)) + ABOVE) * FINE) + 1
    top = F.lit(2 * ABOVE * FINE)
    size = F.when(F.abs(value) == float("inf"), top).otherwise(size)
    return F.when(F.isnan(value), top + 1).when(value == 0, 0).when(value > 0, size).otherwise(-size).cast("long")


def running(df: DataFrame, by: list[str], value: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``df``, with one row a value in each group, and ``<column>_before``: sums over the rows with a smaller (greater) value.

    A group may hold most rows, and as many values as rows. So sums run inside cells of values,
    which are many tasks, and the sums of earlier cells are added: one row a cell.
    """
    d = df.withColumn("__cell", cell(F.col(value).cast("double")) * (-1 if descending else 1))
    order = F.desc(value) if descending else F.asc(value)
    inside = Window.partitionBy(*by, "__cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = d.groupBy(*by, "__cell").agg(*[F.sum(c).alias(f"__s_{c}") for c in columns])
    cells = cells.select(*by, "__cell", *[F.coalesce(F.sum(f"__s_{c}").over(earlier), F.lit(0)).alias(f"__e_{c}") for c in columns])
    d = d.withColumns({f"__i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    on = [*by, "__cell"]
    out = d.join(cells, on) if all(not df.schema[c].nullable for c in by) else d.alias("d").join(cells.alias("c"), [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in on]).select("d.*", *[f"c.__e_{c}" for c in columns])
    return out.withColumns({f"{c}_before": F.col(f"__i_{c}") + F.col(f"__e_{c}") for c in columns}).drop("__cell", *[f"__{x}_{c}" for x in "ie" for c in columns])


def with_totals(df: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates of its groups beside each row."""
    sums = df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    return df.alias("d").join(sums.alias("t"), [F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) for k in by]).select("d.*", *[f"t.{n}" for n in totals]) if by else df.crossJoin(sums)


def at_places(df: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by, name ...): the values at places from 0 of each group in ascending order, places being expressions over ``n``; nulls are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    d = with_totals(running(counts, by, value, ["c"]), by, {"n": F.sum("c")})
    here = lambda p: (F.col("c_before") <= p) & (p < F.col("c_before") + F.col("c"))
    return d.groupBy(*by).agg(*[F.min(F.when(here(p), F.col(value))).alias(name) for name, p in places.items()])


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """(by, name): the value at index round-half-even(q (n - 1)) of each group in ascending order; nulls are left out."""
    return at_places(df, by, value, {name: F.least(F.col("n") - 1, F.bround(q * (F.col("n") - 1)))})


def medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): the mean of the two middle values of each group; nulls are left out."""
    middle = at_places(df, by, value, {"__lo": F.floor((F.col("n") - 1) / 2), "__hi": F.ceil((F.col("n") - 1) / 2)})
    return middle.select(*by, ((F.col("__lo") + F.col("__hi")) / 2).alias(name))


def long_form(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep, feature, value as double): one row for each cell, so that all features run in one job."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("__f")).select(*keep, "__f.*")


def auc(scores: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """(by, n_pos, n_neg, auc): Mann-Whitney AUC with ties averaged; null without both classes."""
    counts = scores.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("m"))
    d = running(counts, by, value, ["m"])
    twice = (2 * F.col("m_before") + F.col("m")).cast("double") * F.col("p")
    g = d.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("m").alias("n_neg"), F.sum(twice).alias("u2"))
    return g.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u2") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def average_precision(scores: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """(by, average_precision): the sum of precision over recall steps at each distinct score, best first."""
    counts = scores.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(positive).alias("p"), F.count("*").alias("c"))
    d = running(counts, by, value, ["p", "c"], descending=True)
    precision = (F.col("p_before") + F.col("p")) / (F.col("c_before") + F.col("c"))
    g = d.groupBy(*by).agg(F.sum(F.col("p") * precision).alias("s"), F.sum("p").alias("n"))
    return g.select(*by, F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("average_precision"))


def ks(df: DataFrame, by: list[str], value: str, side: str, a: str, b: str, least: int = 5) -> DataFrame:
    """(by, n_a, n_b, ks, p_value): the largest gap of the two sides' empirical distributions; needs ``least`` values a side."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(side) == a).alias("x"), F.count_if(F.col(side) == b).alias("y"))
    d = with_totals(running(counts, by, value, ["x", "y"]), by, {"n_a": F.sum("x"), "n_b": F.sum("y")})
    share = lambda c, n: (F.col(f"{c}_before") + F.col(c)) / F.nullif(F.col(n), F.lit(0))
    g = d.groupBy(*by).agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max(F.abs(share("x", "n_a") - share("y", "n_b"))).alias("d"))
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    return g.select(*by, "n_a", "n_b", F.when(enough, F.col("d")).alias("ks"), F.when(enough, ks_p_column("d", "n_a", "n_b")).alias("p_value"))


def ks_p_column(d: str, n: str, m: str) -> Column:
    """``ks_p_value`` as an expression."""
    x = F.col(d) * F.sqrt(F.col(n).cast("double") * F.col(m) / (F.col(n) + F.col(m)))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sample p-value by Kolmogorov's series."""
    from math import exp, sqrt

    x = d * sqrt(n * m / (n + m))
    total = 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * x * x) for k in range(1, 101))
    return 1.0 if x < 0.2 else min(1.0, max(0.0, total))


def _js(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, js) from (by, cell, x, y): base-2 Jensen-Shannon distance of shares."""
    whole = Window.partitionBy(*by)
    d = counts.withColumns({"p": F.col("x") / F.nullif(F.sum("x").over(whole), F.lit(0)), "q": F.col("y") / F.nullif(F.sum("y").over(whole), F.lit(0))})
    mean = (F.col("p") + F.col("q")) / 2
    part = lambda s: F.when(F.col(s) > 0, F.col(s) * F.log2(F.col(s) / mean)).when(F.col(s) == 0, 0.0)
    return d.groupBy(*by).agg(F.sqrt(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0))).alias("js"))


def js_numeric(df: DataFrame, by: list[str], value: str, side: str, a: str, b: str, bins: int = 60) -> DataFrame:
    """(by, js): distance over equal bins of the pooled range; a constant range gives 0, an empty side null."""
    some = df.filter(F.col(value).isNotNull() & F.col(side).isin(a, b))
    span = some.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    d = some.join(F.broadcast(span), by) if by else some.join(F.broadcast(span))
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    d = d.withColumn("cell", F.coalesce(F.least(F.floor((F.col(value) - F.col("__lo")) / width * bins), F.lit(bins - 1)), F.lit(0)))
    counts = d.groupBy(*by, "cell").agg(F.count_if(F.col(side) == a).alias("x"), F.count_if(F.col(side) == b).alias("y"))
    return _js(counts, by)


def js_categorical(df: DataFrame, by: list[str], value: str, side: str, a: str, b: str) -> DataFrame:
    """(by, js) over the values that are not null."""
    some = df.filter(F.col(value).isNotNull() & F.col(side).isin(a, b))
    counts = some.groupBy(*by, F.col(value).alias("cell")).agg(F.count_if(F.col(side) == a).alias("x"), F.count_if(F.col(side) == b).alias("y"))
    return _js(counts, by)


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing, rows, rate) of each column, from one pass."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{i}").alias("missing")) for i, c in enumerate(columns)])
    d = one.select("rows", F.explode(cells).alias("f")).select("f.feature", "f.missing", "rows")
    return d.withColumn("rate", F.when(F.col("rows") > 0, F.col("missing") / F.col("rows")))


def missing_rate_gap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, gap): the feature whose missing rates differ most, the last in order on ties."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    x = missing_rates(a, columns).select("feature", F.col("rate").alias("ra"))
    y = missing_rates(b, columns).select("feature", F.col("rate").alias("rb"))
    d = x.join(y, "feature").withColumn("gap", F.abs(F.col("ra") - F.col("rb")))
    return d.agg(F.max(F.struct("gap", F.element_at(order, F.col("feature")).alias("at"), "feature")).alias("m")).select("m.feature", "m.gap")


def confusion(df: DataFrame, truth: str, predicted: str, times: str | None = None) -> DataFrame:
    """(truth, predicted, n): the rows, or the sum of how many ``times`` each stands for."""
    return df.groupBy(truth, predicted).agg((F.sum(times) if times else F.count("*")).alias("n"))


def binary_metrics(df: DataFrame, truth: str, predicted: str, positive: str) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1, specificity, balanced accuracy, mcc, prevalence."""
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    d = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    c = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn")}
    over = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    n = c["tp"] + c["fp"] + c["fn"] + c["tn"]
    recall, precision, spec = over(c["tp"], c["tp"] + c["fn"]), over(c["tp"], c["tp"] + c["fp"]), over(c["tn"], c["tn"] + c["fp"])
    root = F.sqrt(c["tp"] + c["fp"]) * F.sqrt(c["tp"] + c["fn"]) * F.sqrt(c["tn"] + c["fp"]) * F.sqrt(c["tn"] + c["fn"])
    return d.select(
        "*", over(c["tp"] + c["tn"], n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        over(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]).alias("f1"), spec.alias("specificity"), ((recall + spec) / 2).alias("balanced_accuracy"),
        over(c["tp"] * c["tn"] - c["fp"] * c["fn"], root).alias("mcc"), over(c["tp"] + c["fn"], n).alias("prevalence"),
        over(c["fp"], c["fp"] + c["tn"]).alias("false_positive_rate"), over(c["fn"], c["fn"] + c["tp"]).alias("false_negative_rate"),
    )


def class_metrics(df: DataFrame, truth: str, predicted: str, times: str | None = None) -> DataFrame:
    """(label, support, precision, recall, f1) of each class seen on either side."""
    c = confusion(df, truth, predicted, times)
    rows = c.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    cols = c.groupBy(F.col(predicted).alias("l2")).agg(F.sum("n").alias("called"))
    j = rows.join(cols, F.col("label") == F.col("l2"), "full_outer").select(F.coalesce("label", "l2").alias("label"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "hit", "called")])
    over = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    return j.select("label", "support", over(F.col("hit"), F.col("called")).alias("precision"), over(F.col("hit"), F.col("support")).alias("recall"), over(2 * F.col("hit"), F.col("called") + F.col("support")).alias("f1"))


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean recall over the classes that occur."""
    return class_metrics(df, truth, predicted).filter("support > 0").agg(F.avg("recall").alias("balanced_accuracy"))


def seed_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, population deviation, least and greatest of each metric over seeds."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))]
    return df.groupBy(*by).agg(F.count("*").alias("seeds"), *aggs)


def prevalence(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share)."""
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def support(df: DataFrame, rows: str, columns: str, names: list[str]) -> DataFrame:
    """Counts by class and domain, a column for each domain."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(columns) == n).alias(n) for n in names])


def balance(df: DataFrame, label: str, benign: str = "BENIGN") -> DataFrame:
    """``prevalence`` of each label, and the share of attack rows over all."""
    attacks = df.agg(F.avg((F.col(label) != benign).cast("int")).alias("attack_share"))
    return prevalence(df, label).crossJoin(attacks)
