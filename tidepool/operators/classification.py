"""Classifier and regression metrics by aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.windows import binned, quantile_edges, running_before, with_average_rank


def correlation(a: Column, b: Column) -> Column:
    """The correlation of two columns as an aggregate; null where either is constant (``corr`` would divide by zero)."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _over(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if((y == a) & (p == b)).alias(c) for c, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))))


def classification_metrics(df: DataFrame, label: str, predicted: str, by: Sequence[str] = (), least: int = 0) -> DataFrame:
    """Counts, accuracy, precision, recall, specificity, F1, F2 and MCC (0 where undefined), for groups of at least ``least`` rows."""
    c = confusion(df, label, predicted, by).where(F.col("n") >= least)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    p, r = _over(tp, tp + fp), _over(tp, tp + fn)
    f = lambda b: _over((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp)
    mcc = _over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.withColumns({"accuracy": _over(tp + tn, tp + fp + fn + tn), "precision": p, "recall": r, "specificity": _over(tn, tn + fp), "f1": f(1), "f2": f(2), "mcc": mcc})


def by_bins(df: DataFrame, col: str, q: int, out: str = "bin") -> DataFrame:
    """``df`` with its bin Q1 to Qq by exact quantiles of a column, for metrics by bin."""
    return df.withColumn(out, binned(F.col(col), quantile_edges(df, col, q), [f"Q{i}" for i in range(1, q + 1)]))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the area under the ROC curve from the counts of each distinct score (ties count half); null with one class."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    x = running_before(per, "s", {"below": "n"})
    return x.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("roc_auc"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, from the highest: threshold, tp, fp, precision, recall, fpr."""
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    total = per.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("P"), F.coalesce(F.sum("n"), F.lit(0)).alias("N")).first()
    x = running_before(per, "threshold", {"pb": "p", "nb": "n"}).withColumns({"P": F.lit(total["P"]), "N": F.lit(total["N"])})
    x = x.withColumns({"tp": F.col("P") - F.col("pb"), "fp": F.col("N") - F.col("nb")})
    return x.select("threshold", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _over(F.col("tp"), F.col("P")).alias("recall"), _over(F.col("fp"), F.col("N")).alias("fpr"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the sum of precision times the step of recall over distinct thresholds."""
    own = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"))
    total = F.lit(own.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p")).first()["p"]).cast("double")
    return pr_curve(df, label, score).join(own, "threshold").agg(F.sum(_over(F.col("p").cast("double"), total) * F.col("precision")).alias("average_precision"))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Classification metrics at each threshold: rows are spread to one per threshold before a partial count."""
    t = df.withColumn("threshold", F.explode(F.array(*(F.lit(float(x)) for x in thresholds)))).withColumn("__p", (F.col(score) >= F.col("threshold")).cast("int"))
    return classification_metrics(t, label, "__p", ["threshold"])


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: str | None = None, least: int = 0, eps: float = 1e-8) -> DataFrame:
    """n, MAE, MSE, RMSE, R2 and MAPE, weighted if a weight is given; R2 is null for a constant y."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = F.col(p) - F.col(y)
    s = lambda x: F.sum(w * x)
    t = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), s(F.abs(e)).alias("sa"), s(e * e).alias("se"), s(F.col(y)).alias("sy"), s(F.col(y) * F.col(y)).alias("syy"), s(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(eps))).alias("sp")).where(F.col("n") >= least)
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    return t.select(*by, "n", (F.col("sa") / F.col("sw")).alias("mae"), (F.col("se") / F.col("sw")).alias("mse"), F.sqrt(F.col("se") / F.col("sw")).alias("rmse"), F.when(spread > 0, 1 - F.col("se") / spread).alias("r2"), (F.col("sp") / F.col("sw")).alias("mape"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of average ranks; null where either is constant."""
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    r = with_average_rank(with_average_rank(r, a, "__a"), b, "__b")
    return r.agg(correlation(F.col("__a"), F.col("__b")).alias("spearman"))


def pairwise_correlation(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b, correlation for pairs of columns, in one aggregation."""
    x = df.select(*cols)
    if method == "spearman":
        for c in cols:
            x = with_average_rank(x, c, f"__r_{c}").drop(c).withColumnRenamed(f"__r_{c}", c)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = x.agg(*(correlation(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(str(i)).alias("correlation")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """One row: w0 = 1, w1 = negatives / positives; both 1 if a class is empty."""
    p, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(F.lit(1.0).alias("w0"), F.when((p > 0) & (n > 0), n / p).otherwise(F.lit(1.0)).alias("w1"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, exact and within-one agreement of two raters, and their rank correlation."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = F.abs(F.col(a) - F.col(b))
    rates = both.agg(F.count(F.lit(1)).alias("n"), F.avg((d == 0).cast("double")).alias("exact"), F.avg((d <= 1).cast("double")).alias("within_one"))
    return rates.join(spearman(both, a, b), F.lit(True))


def baselines(train: DataFrame, label: str) -> DataFrame:
    """One row: what constant predictors learn: positive rate, majority class, mean."""
    y = F.col(label)
    return train.agg(F.avg(y.cast("double")).alias("positive_rate"), (F.avg(y.cast("double")) >= 0.5).cast("int").alias("majority"), F.avg(y).alias("mean"))
