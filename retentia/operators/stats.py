"""Statistical drivers.

Every test is reduced to sufficient statistics that Spark aggregates in one
pass (counts, sums, sums of squares and cross-products, kept exact as
DECIMAL where the inputs are decimal), then finished on the small result:
p-values are driver-side math on a one-row table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf, f_sf, t_sf_two_sided
from ..functions.exprs import round_money
from ..functions.tails import chi2_tail, f_tail
from ..session import ship_code, write_once
from .ordered import successive_diff_sq_sum
from .quantiles import exact_median


# Fixed values of the reference: the columns of its correlation matrices
# (script, notebook) and of its account-level regression.
CORR_COLUMNS = ["tenure_months", "total_mrr", "seats", "error_rate_per_100_events",
                "total_duration_hours", "avg_session_duration_mins", "total_tickets", "avg_csat",
                "avg_first_response_min", "avg_resolution_hours", "churn_flag"]
CORR_COLUMNS_B = ["total_mrr", "seats", "tenure_months", "error_rate_per_100_events", "avg_csat",
                  "avg_first_response_min", "total_tickets", "churn_flag"]
ACCOUNT_CSAT_REGRESSORS = ["avg_first_response_min", "avg_resolution_hours", "total_escalations",
                           "error_rate_per_100_events"]


# ------------------------------------------------------------------ A9
def group_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """count, mean, median, sample std and sum of ``value`` per group, at two
    decimals. Sums and sums of squares are exact DECIMAL, so the result does
    not depend on row order. Rows without a group are dropped."""
    df = write_once(df.where(F.col(group).isNotNull()).select(group, value), "groups")
    x = F.col(value).cast("decimal(18,2)")
    agg = df.groupBy(group).agg(
        F.count(x).alias("count"), F.sum(x).alias("_s"), F.sum(x * x).alias("_ss"))
    n = F.col("count").cast("double")
    s = F.col("_s").cast("double")
    # the subtraction that loses digits is done in DECIMAL
    spread = (F.col("count").cast("decimal(12,0)") * F.col("_ss").cast("decimal(26,4)") - F.col("_s").cast("decimal(19,2)") * F.col("_s").cast("decimal(19,2)")).cast("double")
    var = F.when(F.col("count") > 1, spread / (n * (n - 1.0)))
    med = exact_median(df, value, [group], name="_med")
    return agg.join(med, group, "left").select(
        group, "count",
        round_money(F.try_divide(s, n)).alias("mean"),
        round_money("_med").alias("median"),
        round_money(F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"),
        round_money(s).alias("sum"))


# ------------------------------------------------------------------ T6
def anova(df: DataFrame, value: str, group: str, digits: int = 6) -> DataFrame:
    """One-way ANOVA (one row): k groups, n rows, SSB, SSW, F. Rows with a
    NULL group or value are dropped (a NULL group would be an empty sample).
    Group sums are exact DECIMAL and so are the subtractions:
    SSW = sum_g (n_g SS_g - S_g^2) / n_g and SSB = sum_g (n S_g - n_g S)^2 / (n_g n^2)."""
    x = F.col(value).cast("decimal(18,2)")
    g = (df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
         .groupBy(group).agg(F.count(x).alias("n_g"), F.sum(x).alias("s_g"), F.sum(x * x).alias("ss_g")))
    whole = Window.partitionBy(F.lit(0))  # one row a group
    g = g.withColumn("n", F.sum("n_g").over(whole)).withColumn("s", F.sum("s_g").over(whole))

    def dec(c, digits, scale=0):
        return F.col(c).cast(f"decimal({digits},{scale})")
    within = (dec("n_g", 12) * dec("ss_g", 26, 4) - dec("s_g", 19, 2) * dec("s_g", 19, 2)).cast("double") / F.col("n_g").cast("double")
    off = (dec("n", 12) * dec("s_g", 24, 2) - dec("n_g", 12) * dec("s", 24, 2)).cast("double") / F.col("n").cast("double")
    tot = g.select("n", F.lit(1).alias("one"), within.alias("w"), (off * off / F.col("n_g").cast("double")).alias("b")).agg(
        F.sum("one").alias("k"), F.max("n").alias("n"), F.sum("b").alias("ssb"), F.sum("w").alias("ssw"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    ssb, ssw = F.col("ssb"), F.col("ssw")
    fstat = F.try_divide(ssb / (k - 1.0), ssw / (n - k))
    tot = tot.withColumn("f", F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), fstat)).withColumn("p", f_tail(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k")))
    return tot.select(F.col("k").cast("bigint").alias("groups"), F.col("n").cast("bigint").alias("n"),
                      F.round(ssb, 2).alias("ss_between"), F.round(ssw, 2).alias("ss_within"),
                      (F.col("k") - 1).cast("bigint").alias("df_between"),
                      (F.col("n") - F.col("k")).cast("bigint").alias("df_within"),
                      F.round("f", digits).alias("f_statistic"),
                      F.round("p", 4).alias("p_value"), (F.col("p") < 0.05).alias("statistically_significant"))


def anova_test(df: DataFrame, value: str, group: str) -> dict:
    r = anova(df, value, group, digits=12).first()
    p = f_sf(r["f_statistic"], r["df_between"], r["df_within"]) if r["f_statistic"] is not None else None
    return {"f_statistic": r["f_statistic"], "p_value": p,
            "statistically_significant": bool(p is not None and p < 0.05)}


# ------------------------------------------------------------------ A14, T7, T8
def crosstab(df: DataFrame, row: str, colname: str, values: list) -> DataFrame:
    """Counts of row x column with the column values given (no extra job),
    missing cells 0; rows without a row label are dropped. Columns are named ``<col>_<value>``."""
    p = df.where(F.col(row).isNotNull()).groupBy(row).pivot(colname, values).agg(F.count(F.lit(1)))
    return p.select(row, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("bigint").alias(f"{colname}_{v}")
                           for v in values])


def chi_square(df: DataFrame, row: str, colname: str, digits: int = 6) -> DataFrame:
    """Pearson chi-square test of independence, one row per cell: observed,
    expected = row total x column total / n, the cell's contribution, and the
    statistic and degrees of freedom (repeated on every cell). No continuity
    correction (it only applies at one degree of freedom)."""
    cells = (df.where(F.col(row).isNotNull() & F.col(colname).isNotNull())
             .groupBy(row, colname).agg(F.count(F.lit(1)).alias("observed")))
    # the cell table has (#rows x #cols) entries: global windows are cheap
    rt = F.sum("observed").over(Window.partitionBy(row))
    ct = F.sum("observed").over(Window.partitionBy(colname))
    n = F.sum("observed").over(Window.partitionBy())
    nr = F.size(F.collect_set(row).over(Window.partitionBy()))
    nc = F.size(F.collect_set(colname).over(Window.partitionBy()))
    c = cells.select(row, colname, "observed", ((rt * ct).cast("double") / n.cast("double")).alias("expected"),
                     ((nr - 1) * (nc - 1)).cast("bigint").alias("dof"))
    c = c.withColumn("contribution", (F.col("observed") - F.col("expected")) ** 2 / F.col("expected"))
    stat = F.sum("contribution").over(Window.partitionBy())
    c = c.withColumn("_stat", stat).withColumn("_p", chi2_tail(F.col("_stat"), F.col("dof")))
    return c.select(row, colname, "observed", F.round("expected", digits).alias("expected"),
                    F.round("contribution", digits).alias("contribution"),
                    F.round("_stat", digits).alias("chi2_statistic"), "dof",
                    F.round("_p", 4).alias("p_value"), (F.col("_p") < 0.05).alias("statistically_significant"))


def chi_square_test(df: DataFrame, row: str, colname: str) -> dict:
    r = chi_square(df, row, colname, digits=12).select("chi2_statistic", "dof").first()
    p = chi2_sf(r["chi2_statistic"], r["dof"])
    return {"chi2_statistic": r["chi2_statistic"], "p_value": p, "dof": r["dof"],
            "statistically_significant": bool(p < 0.05)}


# ------------------------------------------------------------------ A15
def correlation(df: DataFrame, cols: list[str], digits: int = 3) -> DataFrame:
    """Pearson correlations, pairwise-complete, in long form (var_a, var_b, r),
    at the reference's three decimals.

    Two passes over the columns, written once: means and NULL counts, then the
    sums of centred products. A pair with NULLs takes its moments from the rows
    where both are present. A constant column has no correlation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    data = write_once(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), "correlation")
    one = data.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"k{i}") for i, c in enumerate(cols)]).first()
    constant = {c for i, c in enumerate(cols) if one[f"k{i}"]}
    x = {c: F.col(c) - F.lit(one[f"m{i}"] or 0.0) for i, c in enumerate(cols)}
    full = {c for i, c in enumerate(cols) if not one[f"n{i}"]}

    def r(a, b):
        if a in constant or b in constant:
            return F.lit(None).cast("double")
        if a in full and b in full:
            xy, xx, yy = F.sum(x[a] * x[b]), F.sum(x[a] * x[a]), F.sum(x[b] * x[b])
        else:
            xy, xx, yy = F.regr_sxy(x[a], x[b]), F.regr_syy(x[a], x[b]), F.regr_sxx(x[a], x[b])
        return F.round(F.try_divide(xy, F.sqrt(xx * yy)), digits)

    row = data.agg(*[r(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cell = lambda a, b, i: F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"_{i}").alias("r"))
    cells = [cell(a, b, i) for i, (a, b) in enumerate(pairs)] + [cell(b, a, i) for i, (a, b) in enumerate(pairs) if a != b]
    return row.select(F.inline(F.array(*cells)))


# ------------------------------------------------------------------ T1-T5
def gram(df: DataFrame, y: str, xs: list[str], exact: bool = True) -> DataFrame:
    """Augmented Gram matrix [1 X y]'[1 X y] (upper triangle, long form). With
    ``exact`` the inputs are taken at six decimals and products summed as
    DECIMAL, so the sums are order-free."""
    names = ["const"] + xs + [y]

    def v(c):
        e = F.lit(1) if c == "const" else F.col(c)
        return e.cast("decimal(18,6)") if exact else e.cast("double")

    aggs, keys = [], []
    for i, a in enumerate(names):
        for b in names[i:]:
            aggs.append(F.sum(v(a) * v(b)).cast("double").alias(f"{len(keys)}"))
            keys.append((a, b))
    agg = df.agg(*aggs)
    entries = [F.struct(F.lit(a).alias("row_var"), F.lit(b).alias("col_var"), F.col(f"{i}").alias("value"))
               for i, (a, b) in enumerate(keys)]
    return agg.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def ticket_design(tickets: DataFrame) -> DataFrame:
    """Rated tickets with the reference's regressors."""
    return (tickets.where(F.col("satisfaction_score") > 0)
            .select("ticket_id", F.col("satisfaction_score").cast("double").alias("satisfaction_score"),
                    F.col("first_response_time_minutes").cast("double").alias("first_response_time_minutes"),
                    F.col("resolution_time_hours").cast("double").alias("resolution_time_hours"),
                    F.col("escalation_flag").cast("int").alias("is_escalated"),
                    (F.col("priority") == "Urgent").cast("int").alias("is_urgent"),
                    (F.col("priority") == "High").cast("int").alias("is_high")))


TICKET_REGRESSORS = ["first_response_time_minutes", "resolution_time_hours", "is_escalated",
                     "is_urgent", "is_high"]


def _stacked_r(blocks) -> np.ndarray | None:
    """The R factor of blocks of rows (or of other R factors) on top of each other, with a positive diagonal."""
    r = None
    for block in blocks:
        r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    return None if r is None else r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if r.shape[0] == r.shape[1] else r


# R factors of partitions that one merging group takes.
MERGE_GROUPS = 64


def tall_qr(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of the QR decomposition of [1, columns], a tall and skinny matrix.

    Each task reduces its rows to one R, batch by batch; groups of these are
    merged in Spark and the last few on the driver. No cross products are formed, so a
    design of condition c loses log10(c) digits, not twice as many."""
    ship_code(df.sparkSession)
    width = len(columns) + 1
    rows = df.select(*[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])

    def reduce(batches):
        r = _stacked_r(np.column_stack([np.ones(b.num_rows), *[c.to_numpy(zero_copy_only=False) for c in b.columns]]) for b in batches if b.num_rows)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % MERGE_GROUPS], pa.int64()), pa.array([r.astype(float).tobytes()], pa.binary())], ["part", "r"])

    def merge(group: pa.Table) -> pa.Table:
        ordered = sorted(group.column("r").to_pylist())
        return pa.table({"r": pa.array([_stacked_r(np.frombuffer(x).reshape(-1, width) for x in ordered).astype(float).tobytes()], pa.binary())})

    found = rows.mapInArrow(reduce, "part long, r binary").groupBy("part").applyInArrow(merge, "r binary").toArrow()
    parts = sorted(found.column("r").to_pylist())
    r = _stacked_r([np.frombuffer(x).reshape(-1, width) for x in parts] + [np.zeros((width, width))])
    return r


class OLSResult:
    """Coefficient, fit and diagnostics tables of an OLS fit by tall-skinny QR."""

    def __init__(self, df: DataFrame, y: str, xs: list[str], order_by: str | None = None):
        self.data = write_once(df.select(*([order_by] if order_by else []), y, *xs).na.drop(), "ols")
        self.y, self.xs, self.order_by, self.spark = y, xs, order_by, df.sparkSession
        r = tall_qr(self.data, [*xs, y])
        p = len(xs) + 1
        self.n, self.r, target = self.data.count(), r[:p, :p], r[:p, p]
        self.ssr, self.tss = float(r[p, p] ** 2), float((target[1:] ** 2).sum() + r[p, p] ** 2)
        scale = np.linalg.norm(self.r, axis=0)
        safe = np.where(scale > 0, scale, 1.0)
        self.singular = bool(self.n < p or np.linalg.svd(self.r / safe, compute_uv=False).min() < 1e-13 * p)
        self.coef = np.linalg.lstsq(self.r / safe, target, rcond=None)[0] / safe
        dof = self.n - p
        self.std_err = None
        if not self.singular and dof > 0:
            self.std_err = np.sqrt(self.ssr / dof) * np.linalg.norm(np.linalg.inv(self.r), axis=1)

    def coefficients(self) -> DataFrame:
        rows, dof = [], self.n - len(self.xs) - 1
        for i, name in enumerate(["Intercept"] + self.xs):
            se = None if self.std_err is None else float(self.std_err[i])
            t = float(self.coef[i]) / se if se else None
            rows.append((name, float(self.coef[i]), se, t, None if t is None else _f(t_sf_two_sided(t, dof))))
        return self.spark.createDataFrame(
            rows, "term string, coef double, std_err double, t_value double, p_value double")

    def fit(self) -> DataFrame:
        n, k = self.n, len(self.xs)
        dof = n - k - 1
        r2 = 1.0 - self.ssr / self.tss if self.tss > 0 else float("nan")
        r2adj = 1.0 - (1.0 - r2) * (n - 1) / dof if dof > 0 else None
        fstat = ((self.tss - self.ssr) / k) / (self.ssr / dof) if dof > 0 and self.ssr > 0 else None
        ll = -n / 2.0 * (math.log(2 * math.pi) + math.log(self.ssr / n) + 1.0) if self.ssr > 0 else None
        aic = -2 * ll + 2 * (k + 1) if ll is not None else None
        bic = -2 * ll + math.log(n) * (k + 1) if ll is not None else None
        coefs = self.coefficients().collect()
        sig = [r["term"] for r in coefs if r["p_value"] is not None and r["p_value"] < 0.05]
        row = (n, k, dof, _f(r2), _f(r2adj), fstat,
               f_sf(fstat, k, dof) if fstat is not None else None, ll, aic, bic, sig)
        return self.spark.createDataFrame(
            [row], "n bigint, df_model bigint, df_resid bigint, r_squared double, r_squared_adj double,"
                   " f_statistic double, f_pvalue double, log_likelihood double, aic double,"
                   " bic double, significant_features array<string>")

    def diagnostics(self) -> DataFrame:
        """Residual skew, kurtosis (non-excess), Jarque-Bera, omnibus
        (D'Agostino K^2), Durbin-Watson in ``order_by`` order, condition
        number of the design."""
        fitted = sum((F.col(x).cast("double") * float(b) for x, b in zip(self.xs, self.coef[1:], strict=True)), F.lit(float(self.coef[0])))
        res = self.data.withColumn("_r", F.col(self.y) - fitted)
        m = res.agg(F.count(F.lit(1)).alias("n"), F.skewness("_r").alias("skew"),
                    (F.kurtosis("_r") + 3.0).alias("kurt"), F.sum(F.col("_r") ** 2).alias("ss")).first()
        n, skew, kurt = int(m["n"]), float(m["skew"]), float(m["kurt"])
        jb = n / 6.0 * (skew ** 2 + (kurt - 3.0) ** 2 / 4.0)
        k2 = _dagostino_k2(n, skew, kurt)
        num = successive_diff_sq_sum(res, self.order_by, "_r") if self.order_by else float("nan")
        dw = num / float(m["ss"]) if m["ss"] else float("nan")
        sv = np.linalg.svd(self.r, compute_uv=False)  # the design's singular values are those of R
        cond = float(sv.max() / sv.min()) if sv.min() > 0 else float("inf")
        row = (n, skew, kurt, jb, chi2_sf(jb, 2), k2, chi2_sf(k2, 2), dw, cond)
        return self.spark.createDataFrame(
            [row], "n bigint, skew double, kurtosis double, jarque_bera double, jb_pvalue double,"
                   " omnibus double, omnibus_pvalue double, durbin_watson double, cond_no double")


def gram_matrix(df: DataFrame, xs: list[str]) -> list[list[float]]:
    """[1 X]'[1 X] as a (p+1) x (p+1) nested list (one aggregation pass)."""
    names = ["_one"] + xs
    d = df.withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    r = d.agg(*[F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")).alias(f"{i}_{j}")
                for i, j in pairs]).first()
    out = [[0.0] * len(names) for _ in names]
    for i, j in pairs:
        out[i][j] = out[j][i] = float(r[f"{i}_{j}"])
    return out


def _dagostino_k2(n: int, skew: float, kurt: float) -> float:
    """Omnibus normality statistic from the skewness and kurtosis tests."""
    if n < 8:
        return float("nan")
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1.0 + math.sqrt(2.0 * (beta2 - 1.0))
    delta = 1.0 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1.0))
    y = y if y != 0 else 1e-300
    zs = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1.0))
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5))
    x = (kurt - e) / math.sqrt(varb2)
    sqrtbeta1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * math.sqrt(
        6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6.0 + 8.0 / sqrtbeta1 * (2.0 / sqrtbeta1 + math.sqrt(1.0 + 4.0 / sqrtbeta1 ** 2))
    term1 = 1.0 - 2.0 / (9.0 * a)
    denom = 1.0 + x * math.sqrt(2.0 / (a - 4.0))
    term2 = math.copysign(1.0, denom) * ((1.0 - 2.0 / a) / abs(denom)) ** (1.0 / 3.0) if denom != 0 else float("nan")
    zk = (term1 - term2) / math.sqrt(2.0 / (9.0 * a))
    return zs * zs + zk * zk


def _f(v):
    if v is None:
        return None
    v = float(v)
    return None if math.isnan(v) else v


__all__ = ["group_summary", "anova", "anova_test", "crosstab", "chi_square", "chi_square_test",
           "correlation", "gram", "ticket_design", "OLSResult", "gram_matrix", "t_sf_two_sided"]
