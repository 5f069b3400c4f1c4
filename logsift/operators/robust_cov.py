"""Robust-covariance outliers (OD5): minimum covariance determinant by
C-steps (Rousseeuw & Van Driessen 1999), score = -squared Mahalanobis distance.

Spark does the row work; only d x d matrices reach the driver:

* rows are centred and rotated to the principal axes of the classical covariance,
  scaled to unit variance; axes without variance are dropped, so constant or dependent
  columns leave a smaller problem of full rank, and sums don't cancel;
* moments (n, sum z, sum z z^T) of the selected rows are one aggregate of
  built-in sums (partial aggregation, no Python);
* distances are a built-in expression with the precision matrix inlined;
* the C-step cut, the h-th smallest distance, is an exact order statistic from the
  sketch-bracketed selection, never a global sort.

Half of the rows can still lie in a plane that all rows together don't (most windows
hold the same number of logs).  Variances of a subset below ``FLOOR`` of the whole's count as
``FLOOR``, in determinant and precision alike, so such a subset wins as the most
concentrated one with finite distances.

Starts: the classical estimate plus ``n_starts`` hash-chosen halves; each
runs C-steps until the determinant stops falling (<= ``max_steps``).  Then
the consistency correction (median distance / chi-square median) and one
reweighting at the 0.975 chi-square cut, as in the library form.  Chi-square
quantiles use the Wilson-Hilferty approximation (SciPy is not available).
A null or NaN feature is an error.  The moments are d * d / 2 sums in one aggregate, so
this is meant for metadata or a few principal components (``MAX_DIM``): reduce
wide features first (``api.train_window_models(pca=k)``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.operators.order import order_statistics, quantile_exact

MAX_DIM = 100
FLOOR = 1e-8
Z975 = 1.959963984540054


def chi2_quantile(d: int, z: float) -> float:
    """Wilson-Hilferty: chi2_p(d) ~ d (1 - 2/(9d) + z sqrt(2/(9d)))^3 with z the normal quantile."""
    a = 2.0 / (9.0 * d)
    return d * (1.0 - a + z * np.sqrt(a)) ** 3


def _moments(df: DataFrame, cols: list[str], where=None):
    """(n, mean, population covariance) of columns that are centred near zero."""
    src = df.filter(where) if where is not None else df
    d = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"q{i}_{j}")
             for i in range(d) for j in range(i, d)]
    r = src.agg(*aggs).first()
    n = r["n"]
    if not n:
        return 0, None, None
    mu = np.array([r[f"s{i}"] for i in range(d)], dtype=float) / n
    q = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
    return n, mu, q / n - np.outer(mu, mu)


def _floored(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lam, vec = np.linalg.eigh(cov)
    return np.maximum(lam, FLOOR), vec


def _precision(cov: np.ndarray) -> np.ndarray:
    lam, vec = _floored(cov)
    return (vec / lam) @ vec.T


def mahalanobis_sq(cols: list[str], mu: np.ndarray, prec: np.ndarray) -> F.Column:
    """Squared Mahalanobis distance as a built-in expression."""
    cen = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mu)]
    terms = [cen[i] * cen[j] * F.lit(float(prec[i, j] * (1 if i == j else 2)))
             for i in range(len(cols)) for j in range(i, len(cols))]
    out = terms[0] if terms else F.lit(0.0)
    for t in terms[1:]:
        out = out + t
    return out


def _logdet(cov):
    return float(np.log(_floored(cov)[0]).sum())


@dataclass
class RobustCovModel:
    columns: list[str]
    location: np.ndarray
    covariance: np.ndarray
    raw_location: np.ndarray
    raw_covariance: np.ndarray
    det_trace: list[float]
    offset: float | None = None
    #: inverse on the axes that have variance; derived from the covariance where not given
    precision: np.ndarray | None = None

    def __post_init__(self):
        if self.precision is None:
            self.precision = np.linalg.pinv(self.covariance, hermitian=True)

    def score(self, df: DataFrame, out_col: str = "anomaly_score") -> DataFrame:
        """-squared distance to the reweighted fit (lower = more anomalous)."""
        return df.withColumn(out_col, -mahalanobis_sq(self.columns, self.location, self.precision))

    def predict(self, scored: DataFrame, score_col: str = "anomaly_score") -> DataFrame:
        if self.offset is None:
            raise ValueError("fitted without contamination: there is no threshold to predict with")
        normal = (F.col(score_col) >= F.lit(self.offset)).cast("int")
        return scored.withColumn("prediction", normal).withColumn("is_anomaly", 1 - normal)


def _c_steps(df, n, cols, mu, cov, h, max_steps, trace, tol=1e-9):
    """C-steps from (mu, cov): keep the h rows nearest (all that tie with the h-th),
    refit, repeat while the log-determinant falls."""
    best = (_logdet(cov), mu, cov)
    for _ in range(max_steps):
        scored = df.withColumn("_d2", mahalanobis_sq(cols, mu, _precision(cov)))
        _, got = order_statistics(scored, "_d2", [h - 1], n=n)
        _, mu2, cov2 = _moments(scored, cols, F.col("_d2") <= F.lit(got[h - 1]))
        if mu2 is None:
            break
        ld = _logdet(cov2)
        trace.append(ld)
        improved = ld < best[0] - tol
        if ld < best[0]:
            best = (ld, mu2, cov2)
        if not improved:
            break
        mu, cov = mu2, cov2
    return best


def _centred(df: DataFrame, cols: list[str], extra: list[str]):
    """(rows with doubles, n, mean, covariance); two aggregates, the second on centred values."""
    bad = sum(F.when(F.col(c).isNull() | F.isnan(F.col(c)), 1).otherwise(0) for c in cols)
    base = df.select(*extra, *[F.col(c).cast("double").alias(c) for c in cols])
    r = base.agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    if not r["n"]:
        raise ValueError("no rows to fit")
    if r["bad"]:
        raise ValueError("features hold null or NaN")
    mean = np.array([r[f"m{i}"] for i in range(len(cols))], dtype=float)
    shifted = base.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(cols, mean)])
    n, off, cov = _moments(shifted, cols)
    return base, n, mean + off, cov


def classical_covariance(df: DataFrame, cols: list[str]) -> RobustCovModel:
    """The plain mean and covariance as a model (what C-steps start from)."""
    _, _, mean, cov = _centred(df, cols, [])
    return RobustCovModel(list(cols), mean, cov, mean, cov, [])


def fit_robust_covariance(df: DataFrame, cols: list[str], contamination: float | None = 0.1,
                          n_starts: int = 2, max_steps: int = 30, seed: int = 42,
                          key: str | None = None) -> RobustCovModel:
    if len(cols) > MAX_DIM:
        raise ValueError(f"reduce the features to {MAX_DIM} columns first, e.g. by principal components")
    rows, n, mean, cov = _centred(df, cols, [key] if key else [])
    lam, vec = np.linalg.eigh(cov)
    kept = lam > max(lam.max(), 0.0) * 1e-12
    lam, vec = lam[kept], vec[:, kept]
    d = len(lam)
    to_z, from_z = (vec / np.sqrt(lam)).T, vec * np.sqrt(lam)  # z = to_z (x - mean)
    zs = [f"_z{i}" for i in range(d)]

    def axis(w):
        out = F.lit(0.0)
        for c, m, k in zip(cols, mean, w):
            out = out + (F.col(c) - F.lit(float(m))) * F.lit(float(k))
        return out

    model_of = lambda mu, cv, raw_mu, raw_cv, trace: RobustCovModel(
        list(cols), mean + from_z @ mu, from_z @ cv @ from_z.T, mean + from_z @ raw_mu, from_z @ raw_cv @ from_z.T, trace,
        precision=to_z.T @ _precision(cv) @ to_z)
    if not d:  # all rows are equal
        model = RobustCovModel(list(cols), mean, cov, mean, cov, [], precision=np.zeros((len(cols), len(cols))))
        model.offset = 0.0 if contamination else None
        return model
    base = rows.select("*", *[axis(to_z[i]).alias(z) for i, z in enumerate(zs)]).persist()
    try:
        mu, cv = np.zeros(d), np.eye(d)
        h = min(n, int(np.ceil((n + d + 1) / 2.0)))
        trace: list[float] = []
        # FastMCD-style: two C-steps from every start, then the best start to convergence
        cands = [_c_steps(base, n, zs, mu, cv, h, 2, trace)]
        hkey = F.xxhash64(*([F.col(key)] if key else [F.col(c) for c in cols]))
        for s in range(n_starts):
            u = F.pmod(F.xxhash64(hkey, F.lit(seed + s)), F.lit(1 << 30)) / float(1 << 30)
            _, m0, c0 = _moments(base, zs, u < F.lit(0.5))
            if m0 is not None:
                cands.append(_c_steps(base, n, zs, m0, c0, h, 2, trace))
        _, mu_b, cov_b = min(cands, key=lambda c: c[0])
        _, raw_mu, raw_cov = _c_steps(base, n, zs, mu_b, cov_b, h, max_steps, trace)
        # consistency correction, then one reweighting step
        d2 = base.withColumn("_d2", mahalanobis_sq(zs, raw_mu, _precision(raw_cov)))
        med = quantile_exact(d2, "_d2", 0.5)
        raw_cov = raw_cov * ((med / chi2_quantile(d, 0.0)) if med else 1.0)
        d2 = base.withColumn("_d2", mahalanobis_sq(zs, raw_mu, _precision(raw_cov)))
        _, mu_w, cov_w = _moments(d2, zs, F.col("_d2") < F.lit(chi2_quantile(d, Z975)))
        if mu_w is None:
            mu_w, cov_w = raw_mu, raw_cov
        model = model_of(mu_w, cov_w, raw_mu, raw_cov, trace)
        if contamination:
            model.offset = quantile_exact(model.score(base), "anomaly_score", contamination)
        return model
    finally:
        base.unpersist()
