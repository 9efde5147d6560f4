"""Survival analysis: Kaplan-Meier with confidence band, log-rank, the
notebook's naive curve, headline figures and Cox proportional hazards.

Rows are first reduced to (group, time) with event and row counts. That table
may be as long as the input when times are continuous, so reverse running sums
for the risk sets, the product-limit product and the Greenwood sums run over
ranges of times (``ordered.range_scan``), never over a whole group in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf, normal_sf
from ..functions.tails import chi2_tail
from ..functions.exprs import pct_half_up, round_money, stable_mean
from ..session import discard, ship_code, write_once
from .ordered import range_count, range_scan, ranged
from .quantiles import exact_median

Z_95 = 1.959963984540054  # standard normal quantile at 0.975


def _time_table(df: DataFrame, duration: str, event: str, by: list[str]) -> DataFrame:
    """(by..., t, removed, events) per distinct time; rows without a group are dropped."""
    for c in by:
        df = df.where(F.col(c).isNotNull())
    return (df.where(F.col(duration).isNotNull() & F.col(event).isNotNull())
            .groupBy(*by, F.col(duration).cast("double").alias("t"))
            .agg(F.count(F.lit(1)).alias("removed"),
                 F.sum(F.col(event).cast("bigint")).alias("events")))


def _risk_sets(tt: DataFrame, by: list[str]) -> DataFrame:
    """Adds at_risk = #(T >= t), a running sum from each group's last time down, over ranges of times."""
    return range_scan(ranged(tt, "t", "times"), by, "t", [("at_risk", "removed", "sum")], descending=True)


def kaplan_meier(df: DataFrame, duration: str, event: str, by: list[str] | None = None,
                 digits: int = 6) -> DataFrame:
    """Product-limit estimate S(t) = prod_{s<=t} (1 - d_s / n_s) at every
    distinct time, plus an origin row t = 0, S = 1 when no time is 0.
    Columns: by..., t, at_risk, events, censored, survival. Risk sets and the
    product run over ranges of times (``ordered.range_scan``), so distinct times may be as many
    as rows; the origin row comes from each group's first time row."""
    by = list(by or [])
    rs = _risk_sets(_time_table(df, duration, event, by), by).withColumn("_stay", 1.0 - F.col("events") / F.col("at_risk"))
    km = range_scan(rs, by, "t", [("survival", "_stay", "product"), ("_before", "removed", "sum")])
    row = F.struct(F.col("t"), F.col("at_risk"), F.col("events"),
                   (F.col("removed") - F.col("events")).alias("censored"),
                   F.round("survival", digits).alias("survival"))
    origin = F.struct(F.lit(0.0).alias("t"), F.col("at_risk"), F.lit(0).cast("bigint").alias("events"),
                      F.lit(0).cast("bigint").alias("censored"), F.lit(1.0).alias("survival"))
    # at the first time of a group, where only its own rows have left, at_risk is the group size
    first = F.col("_before") == F.col("removed")
    rows = F.when(first & (F.col("t") > 0), F.array(origin, row)).otherwise(F.array(row))
    return km.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def kaplan_meier_confidence(df: DataFrame, duration: str, event: str,
                            by: list[str] | None = None, z: float = Z_95,
                            digits: int = 6) -> DataFrame:
    """KM with Greenwood variance sum V(t) = sum d/(n(n-d)) (0 where n = d)
    and log(-log) 95% limits exp(-exp(log(-log S) -/+ z sqrt(V)/log S));
    limits are 1 where S = 1 (no information yet)."""
    by = list(by or [])
    rs = _risk_sets(_time_table(df, duration, event, by), by)
    term = F.coalesce(F.try_divide(F.col("events").cast("double"),
                                   (F.col("at_risk") * (F.col("at_risk") - F.col("events"))).cast("double")),
                      F.lit(0.0))
    km = range_scan(rs.withColumns({"_stay": 1.0 - F.col("events") / F.col("at_risk"), "_term": term}), by, "t",
                    [("survival", "_stay", "product"), ("greenwood", "_term", "sum")])
    s, v = F.col("survival"), F.col("greenwood")
    logs = F.log(s)

    def bound(sign):
        inner = F.log(-logs) + F.lit(sign * z) * F.sqrt(v) / logs
        return (F.when(s >= 1.0, F.lit(1.0)).when(s <= 0.0, F.lit(0.0))
                .otherwise(F.exp(-F.exp(inner))))

    return km.select(*by, "t", "at_risk", "events",
                     F.round(s, digits).alias("survival"),
                     F.round(v, digits).alias("greenwood_var_sum"),
                     F.round(bound(+1), digits).alias("ci_lower"),
                     F.round(bound(-1), digits).alias("ci_upper"))


def logrank(df: DataFrame, duration: str, event: str, group: str, a: str, b: str,
            digits: int = 6) -> DataFrame:
    """Two-sample log-rank statistic (one row): at each distinct event time of
    the pooled sample, E_a = d n_a / n and V = d (n_a/n)(1 - n_a/n)(n-d)/(n-1);
    chi2 = (O_a - E_a)^2 / V with one degree of freedom."""
    two = df.where(F.col(group).isin(a, b))
    tt = (two.where(F.col(duration).isNotNull() & F.col(event).isNotNull())
          .groupBy(F.col(duration).cast("double").alias("t"))
          .agg(F.count(F.lit(1)).alias("removed"),
               F.sum(F.col(event).cast("bigint")).alias("d"),
               F.count_if(F.col(group) == a).alias("removed_a"),
               F.sum(F.when(F.col(group) == a, F.col(event).cast("bigint")).otherwise(0)).alias("d_a")))
    rs = range_scan(ranged(tt, "t", "times"), [], "t", [("n", "removed", "sum"), ("n_a", "removed_a", "sum")], descending=True).where(F.col("d") > 0)
    frac = F.col("n_a") / F.col("n")
    e_a = F.col("d") * frac
    var = F.coalesce(F.try_divide(F.col("d") * frac * (1.0 - frac) * (F.col("n") - F.col("d")),
                                  (F.col("n") - 1).cast("double")), F.lit(0.0))
    agg = rs.agg(F.sum("d_a").cast("double").alias("observed_a"),
                 F.sum(e_a).alias("expected_a"), F.sum(var).alias("variance"))
    stat = F.try_divide((F.col("observed_a") - F.col("expected_a")) ** 2, F.col("variance"))
    p = chi2_tail(stat, F.lit(1))
    return agg.select(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), "observed_a",
                      F.round("expected_a", digits).alias("expected_a"),
                      F.round("variance", digits).alias("variance"),
                      F.round(stat, digits).alias("test_statistic"),
                      F.round(p, 4).alias("p_value"), (p < 0.05).alias("statistically_significant"))


def logrank_test(df: DataFrame, duration: str, event: str, group: str, a: str, b: str) -> dict:
    """Statistic and p-value (chi-square, 1 df) as a dict. The p-value is
    driver-side math on the one-row result."""
    row = logrank(df, duration, event, group, a, b, digits=12).first()
    stat = row["test_statistic"]
    return {"test_statistic": stat, "p_value": chi2_sf(stat, 1) if stat is not None else None}


def naive_survival(df: DataFrame, duration: str, event: str, by: list[str]) -> DataFrame:
    """Notebook curve: at each distinct time t of a group, the share of the
    group's accounts with T >= t or no churn = 1 - #(churned, T < t) / N.
    It ignores censoring and is not Kaplan-Meier."""
    tt = ranged(_time_table(df, duration, event, by), "t", "times")
    sizes = tt.groupBy(*by).agg(F.sum("removed").alias("_n"))
    out = range_scan(tt, by, "t", [("_k", "events", "sum")], inclusive=False).join(sizes, by)
    return out.select(*by, "t", ((F.col("_n") - F.col("_k")).cast("double")
                                 / F.col("_n").cast("double")).alias("survival"))


def survival_headline(c360: DataFrame, duration: str = "tenure_months",
                      event: str = "churn_flag") -> DataFrame:
    """Accounts, churned, retention % (2 dp), exact median and mean tenure."""
    h = c360.agg(F.count(F.lit(1)).alias("total_accounts"),
                 F.sum(F.col(event).cast("bigint")).alias("churned_accounts"),
                 round_money(stable_mean(duration, 1)).alias("mean_tenure_months"))
    med = exact_median(c360, duration, name="median_tenure_months")
    return h.crossJoin(med).select(
        "total_accounts", "churned_accounts",
        pct_half_up(F.col("total_accounts") - F.col("churned_accounts"), "total_accounts", 2)
        .alias("retention_rate_pct"),
        "median_tenure_months", "mean_tenure_months")


# --------------------------------------------------------------------- Cox PH
COX_COVARIATES = ["seats", "is_trial", "error_rate_per_100_events", "avg_first_response_min",
                  "avg_csat", "annual_billing_ratio", "net_expansion_score"]


def cox_risk_sets(df: DataFrame, duration: str, event: str, covariates: list[str],
                  digits: int = 6) -> DataFrame:
    """Risk-set sums at beta = 0 for every distinct event time: at-risk count,
    events, sum of each covariate over the risk set (T >= t) and over the
    events at t. These are the sufficient statistics of the Cox score test
    and of the first Newton step."""
    cols = [duration, event] + covariates
    d = df.select(*cols).na.drop()
    tt = d.groupBy(F.col(duration).cast("double").alias("t")).agg(
        F.count(F.lit(1)).alias("removed"),
        F.sum(F.col(event).cast("bigint")).alias("events"),
        *[F.sum(F.col(c).cast("double")).alias(f"_x_{c}") for c in covariates],
        *[F.sum(F.when(F.col(event).cast("bigint") == 1, F.col(c).cast("double")).otherwise(0.0))
          .alias(f"d1_{c}") for c in covariates])
    out = range_scan(ranged(tt, "t", "times"), [], "t", [("at_risk", "removed", "sum")] + [(f"s1_{c}", f"_x_{c}", "sum") for c in covariates], descending=True)
    return (out.where(F.col("events") > 0)
            .select("t", "at_risk", "events",
                    *[F.round(f"s1_{c}", digits).alias(f"s1_{c}") for c in covariates],
                    *[F.round(f"d1_{c}", digits).alias(f"d1_{c}") for c in covariates]))


TIE_CHUNK = 1 << 16  # tie terms that one generated array holds


def efron_sums(times: DataFrame, p: int) -> DataFrame:
    """One row: log-likelihood term, gradient terms g_i and information h_i_j
    of the Efron partial likelihood, from one row per event time.

    ``times`` has d (events at the time), the risk-set sums s0, s1_i, s2_i_j
    and the sums over the events t0, t1_i, t2_i_j. Each time contributes d
    terms, l = 0 .. d - 1, with A = s - (l / d) t; they are generated as rows,
    in chunks that spread a time with very many ties over tasks."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    chunks = times.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("d") - 1) / TIE_CHUNK))))
    spread = chunks.repartition(F.xxhash64("s0", "_k"))
    lo = F.col("_k") * TIE_CHUNK
    terms = spread.withColumn("_l", F.explode(F.sequence(lo, F.least(lo + TIE_CHUNK, F.col("d")) - 1)))
    c = F.col("_l").cast("double") / F.col("d").cast("double")
    a0 = F.col("s0") - c * F.col("t0")
    ratios = terms.select(
        F.log(a0).alias("ll"),
        *[((F.col(f"s1_{i}") - c * F.col(f"t1_{i}")) / a0).alias(f"a1_{i}") for i in range(p)],
        *[((F.col(f"s2_{i}_{j}") - c * F.col(f"t2_{i}_{j}")) / a0).alias(f"a2_{i}_{j}") for i, j in pairs])
    return ratios.agg(
        F.sum("ll").alias("ll"), *[F.sum(f"a1_{i}").alias(f"g_{i}") for i in range(p)],
        *[F.sum(F.col(f"a2_{i}_{j}") - F.col(f"a1_{i}") * F.col(f"a1_{j}")).alias(f"h_{i}_{j}") for i, j in pairs])


# Rows of a chunk of the table that the Newton passes read: one chunk is one row of it.
COX_CHUNK = 100_000
# Tied events at one time that the driver adds up itself, for the few times at the ends of chunks.
TIES_ON_DRIVER = 1_000_000


def _pack_chunks(batches, size: int):
    """Rows of a range of times, sorted from the latest down -> chunks of them, numbered in that order over all ranges."""
    number = TaskContext.get().partitionId() << 32
    held, n = [], 0
    for b in batches:
        held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]))
        n += b.num_rows
        while n >= size:
            whole = np.concatenate(held)
            yield _chunk(number, whole[:size])
            held, n, number = [whole[size:]], n - size, number + 1
    if n:
        yield _chunk(number, np.concatenate(held))


def _chunk(number: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows.tobytes()], pa.binary())], ["chunk", "rows"])


def _moments(w: np.ndarray, z: np.ndarray, upper) -> np.ndarray:
    """w, w z and the upper triangle of w z z', a row each."""
    return np.column_stack([w, w[:, None] * z, (w[:, None] * z)[:, upper[0]] * z[:, upper[1]]])


def _rows_of(raw: bytes, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw).reshape(-1, p + 2)
    return rows[:, 0], rows[:, 1], rows[:, 2:]


def _chunk_totals(batches, p: int, beta: np.ndarray):
    upper = np.triu_indices(p)
    for b in batches:
        for number, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            _, _, z = _rows_of(raw, p)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_moments(np.exp(z @ beta), z, upper).sum(0).tobytes()], pa.binary())], ["chunk", "sums"])


def efron_terms(d: np.ndarray, s: np.ndarray, t: np.ndarray, p: int) -> np.ndarray:
    """Summed log term, gradient and information terms of event times with d events, risk sums s and event sums t (a row each)."""
    upper = np.triu_indices(p)
    out = np.zeros(1 + p + len(upper[0]))
    for at in range(0, len(d), 20_000):
        many = d[at: at + 20_000].astype(np.int64)
        for low in range(0, int(many.max(initial=0)), TIE_CHUNK):  # ties in steps of bounded size
            here = np.clip(many - low, 0, TIE_CHUNK)
            row = np.repeat(np.arange(len(many)), here)
            order = np.arange(len(row)) - np.repeat(np.cumsum(here) - here, here) + low
            a = s[at + row] - (order / many[row])[:, None] * t[at + row]
            ratio = a[:, 1:] / a[:, :1]
            first = ratio[:, :p]
            out[0] += np.log(a[:, 0]).sum()
            out[1: 1 + p] += first.sum(0)
            out[1 + p:] += (ratio[:, p:] - first[:, upper[0]] * first[:, upper[1]]).sum(0)
    return out


def _chunk_terms(batches, p: int, beta: np.ndarray, offsets: dict[int, np.ndarray]):
    """A chunk's part of the likelihood, and its first and last time, which other chunks may share, in raw sums."""
    upper = np.triu_indices(p)
    for b in batches:
        for number, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t, e, z = _rows_of(raw, p)
            eta = z @ beta
            m = _moments(np.exp(eta), z, upper)
            risk = offsets[number] + np.cumsum(m, axis=0)
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            last = np.append(first[1:], len(t)) - 1
            events = np.add.reduceat(e, first)
            tied = np.add.reduceat(m * e[:, None], first, axis=0)
            linear = np.add.reduceat(np.column_stack([eta, z]) * e[:, None], first, axis=0)
            inner = np.flatnonzero(events > 0)
            inner = inner[(inner > 0) & (inner < len(first) - 1)]
            sums = np.concatenate([linear[inner].sum(0), efron_terms(events[inner], risk[last[inner]], tied[inner], p)])
            ends = [np.concatenate([[t[first[i]], number, events[i]], linear[i], risk[last[i]], tied[i]]) for i in sorted({0, len(first) - 1})]
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([np.concatenate(ends).tobytes()], pa.binary())], ["sums", "ends"])


def _efron_step(chunks: DataFrame, p: int, beta: np.ndarray):
    """Log partial likelihood, gradient and information (Efron ties) at beta.

    Two passes over the chunks, nothing written: each chunk's sums of w, w z
    and w z z' (w = exp(beta'z)), whose running sums are the chunks' offsets, then each chunk's
    terms from its own running sums. The times at the ends of chunks are put together
    from their parts; one with very many tied events is summed in Spark (``efron_sums``)."""
    spark, q = chunks.sparkSession, 1 + p + p * (p + 1) // 2
    got = chunks.mapInArrow(lambda b: _chunk_totals(b, p, beta), "chunk long, sums binary").toArrow()
    totals = sorted(zip(got.column("chunk").to_pylist(), (np.frombuffer(x) for x in got.column("sums").to_pylist()), strict=True), key=lambda r: r[0])
    offsets, running = {}, np.zeros(q)
    for number, sums in totals:
        offsets[number] = running
        running = running + sums
    got = chunks.mapInArrow(lambda b: _chunk_terms(b, p, beta, offsets), "sums binary, ends binary").toArrow()
    total = np.zeros(1 + p + q)  # linear terms (eta, z), then the log, gradient and information terms
    parts: list[np.ndarray] = []
    order = np.argsort([np.frombuffer(x)[1] for x in got.column("ends").to_pylist()])
    sums, ends = got.column("sums").to_pylist(), got.column("ends").to_pylist()
    for i in order:  # chunk by chunk: the same sum each time
        total += np.frombuffer(sums[i])
        parts += list(np.frombuffer(ends[i]).reshape(-1, 4 + p + 2 * q))
    by_time: dict[float, np.ndarray] = {}
    for r in parts:  # chunks run from the latest time down: the last part of a time has its whole risk set
        t = float(r[0])
        if t in by_time:
            merged = by_time[t] + r
            merged[4 + p: 4 + p + q] = r[4 + p: 4 + p + q]
            by_time[t] = merged
        else:
            by_time[t] = r.copy()
    ends_ = [r for r in by_time.values() if r[2] > 0]
    few, many = [r for r in ends_ if r[2] <= TIES_ON_DRIVER], [r for r in ends_ if r[2] > TIES_ON_DRIVER]
    for r in ends_:
        total[: 1 + p] += r[3: 4 + p]
    if few:
        few = np.stack(few)
        total[1 + p:] += efron_terms(few[:, 2], few[:, 4 + p: 4 + p + q], few[:, 4 + p + q:], p)
    if many:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        names = ["0"] + [f"1_{i}" for i in range(p)] + [f"2_{i}_{j}" for i, j in pairs]
        schema = ", ".join(["d bigint"] + [f"{k}{n} double" for k in "st" for n in names])
        r = efron_sums(spark.createDataFrame([(int(x[2]), *map(float, x[4 + p:])) for x in many], schema), p).first()
        total[1 + p:] += np.array([r["ll"]] + [r[f"g_{i}"] for i in range(p)] + [r[f"h_{i}_{j}"] for i, j in pairs])
    info = np.zeros((p, p))
    info[np.triu_indices(p)] = total[2 + 2 * p:]
    return float(total[0] - total[1 + p]), total[1: 1 + p] - total[2 + p: 2 + 2 * p], info + np.triu(info, 1).T


def cox_chunks(data: DataFrame, p: int, means: np.ndarray, sds: np.ndarray) -> DataFrame:
    """(chunk, rows): the rows from the latest time down, range-partitioned and sorted once, in numbered chunks.

    A hash breaks the ties of the range key, so that a time that very many rows share spreads over partitions."""
    ship_code(data.sparkSession)
    z = [((F.col(f"_x{i}") - float(means[i])) / float(sds[i])).alias(f"_z{i}") for i in range(p)]
    rows = data.select((-F.col("_t")).alias("_down"), "_e0", *z, F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
    size = COX_CHUNK
    ranged = rows.repartitionByRange(range_count(data.count()), "_down", "_salt").sortWithinPartitions("_down", "_salt").drop("_salt")
    return write_once(ranged.mapInArrow(lambda b: _pack_chunks(b, size), "chunk long, rows binary"), "cox-chunks")


def cox_ph(df: DataFrame, duration: str, event: str, covariates: list[str],
           max_iter: int = 50, tol: float = 1e-9) -> tuple[DataFrame, dict]:
    """Cox proportional hazards by Newton-Raphson on the Efron partial
    likelihood. Rows with a NULL in any used column are dropped. Covariates
    are centred and scaled for the iterations and the coefficients mapped
    back. Only a p-vector and a p x p matrix per chunk and iteration reach the driver.
    Returns (coefficient table, fit info); a fit that does not converge in
    ``max_iter`` iterations is an error."""
    spark, p = df.sparkSession, len(covariates)
    data = write_once(df.select(F.col(duration).cast("double").alias("_t"), F.col(event).cast("double").alias("_e0"),
                                *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(covariates)]).na.drop(), "cox")
    st = data.agg(*[F.avg(f"_x{i}").alias(f"m{i}") for i in range(p)],
                  *[F.stddev_samp(f"_x{i}").alias(f"s{i}") for i in range(p)],
                  F.count(F.lit(1)).alias("n"), F.sum("_e0").alias("events")).first()
    means = np.array([st[f"m{i}"] or 0.0 for i in range(p)])
    sds = np.array([(st[f"s{i}"] or 1.0) or 1.0 for i in range(p)])
    chunks = cox_chunks(data, p, means, sds)
    beta = np.zeros(p)
    ll_old, converged, it = None, False, 0
    for it in range(1, max_iter + 1):
        ll, grad, info = _efron_step(chunks, p, beta)
        if ll_old is not None and ll < ll_old - 1e-12 * max(1.0, abs(ll_old)):
            # step-halving when a full step lowers the likelihood
            beta = beta - step / 2.0
            step = step / 2.0
            continue
        try:
            step = np.linalg.solve(info, grad)
        except np.linalg.LinAlgError:
            step = np.linalg.lstsq(info, grad, rcond=None)[0]
        ll_old = ll
        if np.max(np.abs(step), initial=0.0) < 1e-9 or abs(float(grad @ step)) < tol:
            beta = beta + step
            converged = True
            break
        beta = beta + step
    if not converged and st["events"]:
        raise RuntimeError(f"the Cox fit did not converge in {max_iter} iterations")
    ll, grad, info = _efron_step(chunks, p, beta)
    for table in (chunks, data):
        discard(table)
    cov = np.linalg.pinv(info)
    coef = beta / sds
    se = np.sqrt(np.clip(np.diag(cov), 0, None)) / sds
    rows = []
    for c, b, s in zip(covariates, coef, se):
        zstat = b / s if s > 0 else float("nan")
        rows.append((c, float(b), float(math.exp(b)), float(s),
                     float(2.0 * normal_sf(abs(zstat))) if s > 0 else None))
    table = spark.createDataFrame(
        rows, "covariate string, coef double, hazard_ratio double, se_coef double, p_value double")
    return table, {"log_likelihood": ll, "iterations": it, "converged": converged,
                   "n": int(st["n"]), "events": int(st["events"] or 0)}


def cox_hazard_table(df: DataFrame, duration: str = "tenure_months", event: str = "churn_flag",
                     covariates: list[str] = COX_COVARIATES) -> DataFrame:
    """Coefficient table sorted by hazard ratio, descending (V-RANK)."""
    table, _ = cox_ph(df, duration, event, covariates)
    return table.orderBy(F.desc("hazard_ratio"))
