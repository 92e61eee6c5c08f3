"""Shortcut detection: how well one column, or a shallow tree, tells the label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.operators.statistics import auc, medians, running, with_totals


def constants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with one distinct value at most; missing counts as a value.

    A column has one value if its least and greatest text agree and either none or all rows lack it.
    """
    text = lambda c: F.col(c).cast("string")
    one = df.agg(F.count("*").alias("rows"), *[f(text(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))])
    kinds = lambda i: F.when(F.col(f"n_{i}") == 0, F.least("rows", F.lit(1))).when((F.col(f"lo_{i}") == F.col(f"hi_{i}")) & ((F.col(f"n_{i}") == F.col("rows")) | (F.col(f"lo_{i}") == "None")), 1).otherwise(2)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), kinds(i).cast("long").alias("distinct_values")) for i, c in enumerate(columns)])
    return one.select(F.explode(cells).alias("v")).select("v.*").filter("distinct_values <= 1")


def cells(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, value as text, label): one row for each cell."""
    return df.select(F.col(label).alias("label"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for c in columns])).alias("v")).select("label", "v.*")


def categorical(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, balanced_accuracy, n_values, pure_share) of the rule value -> its commonest label.

    Ties among a value's labels go to the first by name. ``pure_share`` is the share of rows whose
    value occurs with one label only.
    """
    counts = cells(df, columns, label).groupBy("feature", "value", "label").agg(F.count("*").alias("n"))
    v = Window.partitionBy("feature", "value")
    counts = counts.withColumns({"pick": F.row_number().over(v.orderBy(F.desc("n"), "label")), "kinds": F.count("*").over(v)})
    recall = counts.groupBy("feature", "label").agg(F.sum(F.when(F.col("pick") == 1, F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("n"))
    score = recall.groupBy("feature").agg(F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))
    shape = counts.groupBy("feature").agg(F.count_distinct("value").alias("n_values"), (F.sum(F.when(F.col("kinds") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("pure_share"))
    return score.join(shape, "feature")


def majority_rule(train: DataFrame, feature: str, label: str) -> DataFrame:
    """(value, guess): each value's commonest label, ties by name."""
    c = train.groupBy(F.col(feature).alias("value"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return c.groupBy("value").agg(F.min(F.struct((-F.col("n")).alias("m"), "label"))["label"].alias("guess"))


def categorical_lift(train: DataFrame, test: DataFrame, feature: str, label: str) -> DataFrame:
    """(accuracy, majority_accuracy, lift, balanced_accuracy) of the rule learned on train; unseen values get the majority."""
    top = train.groupBy(F.col(label).alias("top")).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("m"), "top"))["top"].alias("top"))
    rule = majority_rule(train, feature, label)
    j = test.join(rule, F.col(feature).eqNullSafe(F.col("value")), "left").join(F.broadcast(top)).withColumn("guess", F.coalesce("guess", "top"))
    by = j.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("guess") == F.col(label)).alias("hit"), F.count_if(F.col("top") == F.col(label)).alias("base"))
    d = by.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), (F.sum("base") / F.sum("n")).alias("majority_accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))
    return d.withColumn("lift", F.col("accuracy") - F.col("majority_accuracy"))


def numeric_cells(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    return df.select(F.col(label).alias("label"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")).select("label", "v.*")


def quantile_edges(df: DataFrame, columns: list[str], bins: int = 32) -> DataFrame:
    """(feature, edges): sorted values at every step-th place, step = n // bins, strictly ascending, bins - 1 at most.

    Works on distinct values with running counts: an edge is a value that one of the places falls on.
    """
    c = numeric_cells(df.withColumn("__l", F.lit("")), columns, "__l").filter("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    c = with_totals(running(c, ["feature"], "value", ["n"]), ["feature"], {"total": F.sum("n")})
    step = F.greatest(F.floor(F.col("total") / bins), F.lit(1))
    # Places (from 0) step, 2 step, ... that lie in a value's places: few values have one.
    first = F.greatest(F.ceil(F.col("n_before") / step) * step, step)
    on = c.filter(first < F.col("n_before") + F.col("n"))
    on = on.withColumn("k", F.row_number().over(Window.partitionBy("feature").orderBy("value"))).filter(F.col("k") <= bins - 1)
    return on.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("edges"))


def binned(value: Column, edges: Column) -> Column:
    """The first bin whose edge is not below the value; -1 where it is missing."""
    return F.when(value.isNull(), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda e: e < value)))


def numeric(df: DataFrame, columns: list[str], label: str, bins: int = 32) -> DataFrame:
    """(feature, balanced_accuracy, bin) of the best single split of each column.

    A split sends bins up to ``bin`` to one side. Each side guesses its commonest label, ties by
    name; splits whose sides agree don't count; the earliest of the best wins. Columns without one
    are left out. One shuffle of cells by feature and bin; what follows works on bins.
    """
    edges = quantile_edges(df, columns, bins)
    c = numeric_cells(df, columns, label).join(F.broadcast(edges), "feature", "left")
    counts = c.withColumn("bin", binned(F.col("value"), F.coalesce("edges", F.array().cast("array<double>")))).groupBy("feature", "bin", "label").agg(F.count("*").alias("n"))
    total = counts.groupBy("feature", "label").agg(F.sum("n").alias("total"))
    bins_seen = counts.select("feature", "bin").distinct()
    grid = bins_seen.join(total, "feature").join(counts, ["feature", "bin", "label"], "left").fillna({"n": 0})
    w = Window.partitionBy("feature", "label").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = grid.withColumn("low", F.sum("n").over(w)).withColumn("high", F.col("total") - F.col("low"))
    at = Window.partitionBy("feature", "bin")
    pick = lambda c: F.min(F.struct((-F.col(c)).alias("m"), "label")).over(at)["label"]
    sides = grid.withColumns({"guess_low": pick("low"), "guess_high": pick("high")})
    hit = F.when(F.col("label") == F.col("guess_low"), F.col("low")).otherwise(0) + F.when(F.col("label") == F.col("guess_high"), F.col("high")).otherwise(0)
    score = sides.filter("guess_low <> guess_high").groupBy("feature", "bin").agg(F.avg(hit / F.col("total")).alias("s"), F.sum("high").alias("rest")).filter("rest > 0")
    best = score.groupBy("feature").agg(F.max(F.struct("s", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select("feature", F.col("m.s").alias("balanced_accuracy"), (-F.col("m.b")).alias("bin"))


def numeric_auc(df: DataFrame, columns: list[str], positive: Column) -> DataFrame:
    """(feature, auc): folded AUC of each column, missing values at the median; constant ones are left out."""
    c = df.select(positive.alias("pos"), F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("value")) for x in columns])).alias("v")).select("pos", "v.*")
    shape = c.groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).filter("n >= 5 and lo < hi")
    shape = shape.join(medians(c, ["feature"], "value", "mid"), "feature")
    full = c.join(F.broadcast(shape.select("feature", "mid")), "feature").withColumn("value", F.coalesce("value", "mid"))
    return auc(full, ["feature"], "value", F.col("pos")).select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"))


def top(df: DataFrame, score: str, name: str, n: int, flag: float) -> DataFrame:
    """The n best by (score, name) descending, with ``flagged`` from a threshold on."""
    return df.orderBy(F.desc(score), F.desc(name)).limit(n).withColumn("flagged", F.col(score) >= flag)


def tree(df: DataFrame, columns: list[str], label: str, depth: int = 3, least: int = 50, bins: int = 32) -> list[dict]:
    """A greedy Gini tree over binned columns: nodes with path, counts and the split taken.

    Each level is one grouped count over the binned rows (node, column, bin, label); only these
    counts, bounded by nodes x columns x bins x labels, come to the driver. Text columns are coded
    by the order of their values, at most ``bins`` of them (rarer ones share the last code).
    """
    numbers = [c for c in columns if dict(df.dtypes)[c] != "string"]
    edges = {r.feature: r.edges for r in quantile_edges(df, numbers, bins).collect()} if numbers else {}
    coded = df.select(F.col(label).cast("string").alias("label"), *[_coded(df, c, edges.get(c), bins).alias(f"b_{i}") for i, c in enumerate(columns)])
    nodes: list[dict] = [{"id": 0, "path": []}]
    level = [nodes[0]]
    for at in range(depth + 1):
        node = F.lit(None).cast("int")
        for n in level:
            hit = F.lit(True)
            for i, b, low in n["path"]:
                hit = hit & ((F.col(f"b_{i}") <= b) if low else (F.col(f"b_{i}") > b))
            node = F.when(hit, n["id"]).otherwise(node)
        cells_ = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b_{i}").alias("b")) for i in range(len(columns))])
        rows = coded.withColumn("node", node).filter("node is not null").select("node", "label", F.explode(cells_).alias("c")).groupBy("node", "c.i", "c.b", "label").count().collect()
        following = []
        for n in level:
            mine = [r for r in rows if r.node == n["id"]]
            counts: dict[str, int] = {}
            for r in mine:
                if r.i == 0:
                    counts[r.label] = counts.get(r.label, 0) + r["count"]
            n["counts"] = counts
            n["label"] = min(counts, key=lambda k: (-counts[k], k)) if counts else None
            found = _best(mine, counts, len(columns), least) if at < depth else None
            if found is None:
                continue
            i, b = found
            n["split"] = (columns[i], b)
            for low in (True, False):
                child = {"id": len(nodes), "path": [*n["path"], (i, b, low)]}
                nodes.append(child)
                following.append(child)
        level = following
        if not level:
            break
    return nodes


def _coded(df: DataFrame, column: str, edges: list[float] | None, bins: int) -> Column:
    if edges is not None:
        return binned(F.col(column).cast("double"), F.array(*[F.lit(e) for e in edges]).cast("array<double>"))
    common = df.groupBy(F.col(column).cast("string").alias("v")).count().filter("v is not null").orderBy(F.desc("count"), "v").limit(bins).collect()
    values = sorted(r.v for r in common)
    code = F.array_position(F.array(*[F.lit(v) for v in values]).cast("array<string>"), F.col(column).cast("string"))
    return F.when(F.col(column).isNull(), -1).when(code > 0, code - 1).otherwise(bins).cast("int")


def _gini(counts: dict[str, int]) -> float:
    n = sum(counts.values())
    return 1.0 - sum((c / n) ** 2 for c in counts.values()) if n else 0.0


def _best(rows: list, counts: dict[str, int], columns: int, least: int) -> tuple[int, int] | None:
    """The column and bin of the split with most gain; the first column wins ties."""
    n, base, best = sum(counts.values()), _gini(counts), (1e-9, None)
    for i in range(columns):
        by: dict[int, dict[str, int]] = {}
        for r in rows:
            if r.i == i:
                by.setdefault(r.b, {})[r.label] = r["count"]
        low: dict[str, int] = {}
        for b in sorted(by)[:-1]:
            for k, c in by[b].items():
                low[k] = low.get(k, 0) + c
            high = {k: c - low.get(k, 0) for k, c in counts.items()}
            a, z = sum(low.values()), sum(high.values())
            if a < least or z < least:
                continue
            gain = base - (a * _gini(low) + z * _gini(high)) / n
            if gain > best[0]:
                best = (gain, (i, b))
    return best[1]
