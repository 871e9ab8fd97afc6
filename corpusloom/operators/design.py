"""Design columns and effects of covariates on topic shares."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import normal_quantile
from ..functions.session import cut, small


def one_hot(df: DataFrame, column: str, drop_first: bool = True, prefix: str = "") -> DataFrame:
    """0/1 columns over the sorted categories of a column; the first is the reference."""
    levels = sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(column) == F.lit(v)).cast("double"), F.lit(0.0)) for v in levels[int(drop_first) :]})


def knots(df: DataFrame, column: str, count: int = 4) -> list[float]:
    """``count`` + 1 knots at evenly spaced exact quantiles."""
    return list(df.agg(F.percentile(column, F.array(*[F.lit(i / count) for i in range(count + 1)]))).first()[0])


def spline(column: str, at: list[float], prefix: str = "s") -> dict:
    """Restricted cubic spline columns for ``withColumns``: the linear term, then one per inner segment."""
    x = F.col(column)
    cube = lambda t: F.pow(F.greatest(x - F.lit(t), F.lit(0.0)), 3)
    last, before, scale = at[-1], at[-2], (at[-1] - at[0]) ** 2 or 1.0
    out = {f"{prefix}1": x.cast("double")}
    for i, t in enumerate(at[:-2], 2):
        out[f"{prefix}{i}"] = (cube(t) - cube(before) * F.lit((last - t) / (last - before)) + cube(last) * F.lit((before - t) / (last - before))) / F.lit(scale)
    return out


def interaction(a: list[str], b: list[str]) -> dict:
    """All pairwise products, named a:b."""
    return {f"{x}:{y}": F.col(x) * F.col(y) for x in a for y in b}


class Design:
    """An R-style formula fitted to a table: knots and levels stay fixed for other tables.

    ``~ a + b * c + a:b + spline(x, df=4)``: numbers as they are, text columns as 0/1 columns over their sorted levels
    but the first, ``*`` both terms and their products, ``:`` the products; no intercept (effects add their own).
    """

    def __init__(self, formula: str, df: DataFrame):
        kinds = dict(df.dtypes)
        self.formula, self.terms, self.knots, self.levels = formula, [], {}, {}
        for part in formula.split("~")[-1].replace(" ", "").split("+"):
            if part in ("1", "0", "-1", ""):
                continue
            factors = part.split("*")
            # every non-empty set of the factors, single ones first
            sets = [[f for i, f in enumerate(factors) if m >> i & 1] for m in range(1, 1 << len(factors))] if len(factors) > 1 else [part.split(":")]
            for group in sorted(sets, key=len):
                if group not in self.terms:
                    self.terms.append(group)
        for name in {f for g in self.terms for f in g}:
            call = SPLINE.fullmatch(name)
            column = call[1] if call else name
            if column not in kinds:
                raise ValueError(f"unknown column {column!r} in {formula!r}")
            if call:
                self.knots[name] = knots(df, column, int(call[2] or 4))
            elif kinds[column] in ("string", "boolean"):
                self.levels[name] = sorted(str(r[0]) for r in df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).distinct().collect())

    def _columns(self, factor: str) -> dict:
        if factor in self.knots:
            column = SPLINE.fullmatch(factor)[1]
            return {f"{factor}[{i}]": c for i, c in enumerate(spline(column, self.knots[factor]).values(), 1)}
        if factor in self.levels:
            return {f"{factor}[{v}]": F.coalesce((F.col(factor).cast("string") == F.lit(v)).cast("double"), F.lit(0.0)) for v in self.levels[factor][1:]}
        return {factor: F.col(factor).cast("double")}

    def columns(self) -> dict:
        """{name: column} of the design, in order."""
        out = {}
        for group in self.terms:
            made = {"": None}
            for f in group:
                made = {(f"{n}:{m}" if n else m): (c if old is None else old * c) for n, old in made.items() for m, c in self._columns(f).items()}
            out |= made
        return out

    @property
    def names(self) -> list[str]:
        return list(self.columns())

    def apply(self, df: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and the design's columns of another table, with this one's knots and levels."""
        return df.select(*keep, *[c.alias(n) for n, c in self.columns().items()])


SPLINE = re.compile(r"spline\((\w+)(?:,(?:df=)?(\d+))?\)")


def design_matrix(formula: str, df: DataFrame, *keep: str) -> tuple[DataFrame, Design]:
    """The design's columns of ``df`` beside ``keep``, and the fitted design for other tables."""
    d = Design(formula, df)
    return d.apply(df, *keep), d


@dataclass
class Fit:
    """One topic's regression: coefficients, their covariance, share of variance explained."""

    topic: object
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    r2: float

    def rows(self, z: float) -> list[dict]:
        se = np.sqrt(np.maximum(np.diag(self.cov), 0))
        return [{"topic": self.topic, "feature": f, "coef": b, "se": s, "z": b / s if s > 0 else float("nan"), "low": b - z * s, "high": b + z * s, "r2": self.r2} for f, b, s in zip(self.names, self.coef, se)]


def fit_effects(theta: DataFrame, x: DataFrame, features: list[str], add_intercept: bool = True, cluster: str | None = None, link: str = "identity", iters: int = 50, tol: float = 1e-9) -> list[Fit]:
    """Regressions of every topic's share (doc_id, topic, p[, draw]) on features (doc_id, ...).

    ``link`` identity is least squares with classical errors; with ``cluster``, and for the quasi-likelihood links
    logit and log (reweighted least squares), errors are robust (HC1, CR1 by cluster).  With a column ``draw`` every
    draw is fitted and the fits are pooled: mean coefficients, mean covariance plus (1 + 1 / M) times the covariance
    between draws.  All sums are taken over the documents in Spark; the p x p systems are solved on the driver.
    """
    if link not in ("identity", "logit", "log"):
        raise ValueError(f"unknown link {link!r}")
    names = (["intercept"] if add_intercept else []) + features
    p, groups = len(names), ["topic", *(["draw"] if "draw" in theta.columns else [])]
    side = x.select("doc_id", *[F.col(f"`{f}`").cast("double").alias(f"x{i + int(add_intercept)}") for i, f in enumerate(features)], *([F.col(cluster).alias("_g")] if cluster and cluster != "doc_id" else []))
    d = theta.select("doc_id", *groups, F.col("p").alias("y")).join(side, "doc_id")
    if add_intercept:
        d = d.withColumn("x0", F.lit(1.0))
    d = cut(d)
    up = [(i, j) for i in range(p) for j in range(i, p)]

    def systems(weight, target):
        """{group: (X'WX, X'Wz, n)}"""
        rows = d if weight is None else joined()
        w = F.lit(1.0) if weight is None else weight
        sums = rows.groupBy(*groups).agg(*[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i, j in up], *[F.sum(w * F.col(f"x{i}") * target).alias(f"b{i}") for i in range(p)], F.count(F.lit(1)).alias("n"))
        out = {}
        for r in sums.collect():
            a = np.zeros((p, p))
            for i, j in up:
                a[i, j] = a[j, i] = r[f"a{i}_{j}"]
            out[tuple(r[g] for g in groups)] = (a, np.array([r[f"b{i}"] for i in range(p)]), r["n"])
        return out

    coef: dict = {}

    def joined():
        # one row per topic and draw
        kinds = ", ".join(f"{g} {dict(theta.dtypes)[g]}" for g in groups)
        table = theta.sparkSession.createDataFrame([(*k, b.tolist()) for k, b in coef.items()], f"{kinds}, _b array<double>")
        return d.join(small(table)[0], groups)

    eta = sum((F.col("_b")[i] * F.col(f"x{i}") for i in range(p)), F.lit(0.0))
    if link == "logit":
        mu = F.greatest(F.least(1 / (1 + F.exp(-eta)), F.lit(1 - 1e-8)), F.lit(1e-8))
        weight = mu * (1 - mu)
    elif link == "log":
        mu = F.greatest(F.exp(eta), F.lit(1e-8))
        weight = mu
    else:
        mu, weight = eta, None
    solved = systems(None, F.col("y"))
    n_of = {k: v[2] for k, v in solved.items()}
    if link == "identity":
        bread = {k: np.linalg.pinv(a) for k, (a, _, _) in solved.items()}
        coef = {k: bread[k] @ b for k, (_, b, _) in solved.items()}
    else:
        coef = {k: np.zeros(p) for k in solved}
        for _ in range(iters):
            solved = systems(weight, eta + (F.col("y") - mu) / weight)
            bread = {k: np.linalg.pinv(a) for k, (a, _, _) in solved.items()}
            new = {k: bread[k] @ b for k, (_, b, _) in solved.items()}
            moved = max((np.abs(new[k] - coef[k]).max() for k in new), default=0.0)
            coef = new
            if moved < tol:
                break
        bread = {k: np.linalg.pinv(a) for k, (a, _, _) in systems(weight, eta).items()}
    res = F.col("y") - mu
    errors = {tuple(r[g] for g in groups): r for r in joined().groupBy(*groups).agg(F.sum(res * res).alias("rss"), (F.var_pop("y") * F.count(F.lit(1))).alias("tss")).collect()}
    cov = {}
    if link == "identity" and not cluster:
        cov = {k: bread[k] * errors[k]["rss"] / max(n_of[k] - p, 1) for k in coef}
    else:
        scored = joined().select(*groups, *(["_g"] if cluster and cluster != "doc_id" else [F.col("doc_id").alias("_g")]), *[(F.col(f"x{i}") * res).alias(f"u{i}") for i in range(p)])
        by = scored.groupBy(*groups, "_g").agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in range(p)])
        for r in by.groupBy(*groups).agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in up], F.count(F.lit(1)).alias("g")).collect():
            k, m = tuple(r[g] for g in groups), np.zeros((p, p))
            for i, j in up:
                m[i, j] = m[j, i] = r[f"m{i}_{j}"]
            scale = n_of[k] / max(n_of[k] - p, 1)
            if cluster:
                scale = r["g"] / (r["g"] - 1) * (n_of[k] - 1) / max(n_of[k] - p, 1) if r["g"] > 1 else 1.0
            cov[k] = bread[k] @ m @ bread[k] * scale
    r2 = {k: 1 - errors[k]["rss"] / errors[k]["tss"] if errors[k]["tss"] > 0 else 0.0 for k in coef}
    out = []
    for t in sorted({k[0] for k in coef}, key=lambda t: (str(type(t)), t)):
        of = sorted(k for k in coef if k[0] == t)
        b = np.stack([coef[k] for k in of])
        within = np.mean([cov[k] for k in of], axis=0)
        between = np.atleast_2d(np.cov(b, rowvar=False)) if len(of) > 1 else np.zeros((p, p))
        out.append(Fit(t, names, b.mean(0), within + (1 + 1 / len(of)) * between * (len(of) > 1), float(np.mean([r2[k] for k in of]))))
    return out


def estimate_effect(theta: DataFrame, x: DataFrame, features: list[str], add_intercept: bool = True, cluster: str | None = None, link: str = "identity", ci: float = 0.95) -> list[dict]:
    """``fit_effects`` as rows: topic, feature, coef, se, z, low, high, r2."""
    z = normal_quantile(0.5 + ci / 2)
    return [r for f in fit_effects(theta, x, features, add_intercept, cluster, link) for r in f.rows(z)]


def effect_frame(theta: DataFrame, x: DataFrame, features: list[str], **options) -> DataFrame:
    """``estimate_effect`` as a DataFrame."""
    rows = estimate_effect(theta, x, features, **options)
    names = ["topic", "feature", "coef", "se", "z", "low", "high", "r2"]
    kind = dict(theta.dtypes)["topic"]
    return theta.sparkSession.createDataFrame([tuple(float(r[n]) if n not in names[:2] else r[n] for n in names) for r in rows], f"topic {kind}, feature string, coef double, se double, z double, low double, high double, r2 double")


def reference_rows(df: DataFrame, design: Design, at: dict | None = None, contrast: tuple | None = None, continuous: str | None = None, npoints: int = 20) -> tuple[list, DataFrame]:
    """(labels, rows): a grid of covariate values; other covariates at their mean, or most frequent level.

    ``contrast`` (column, a, b) gives two rows, ``continuous`` a column's range in ``npoints`` steps, else one row.
    """
    kinds = dict(df.dtypes)
    columns = sorted({SPLINE.fullmatch(f)[1] if SPLINE.fullmatch(f) else f for g in design.terms for f in g})
    base = {}
    for c in columns:
        # of equally frequent levels the first
        base[c] = (df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.col("count").desc(), c).first()[0] if kinds[c] in ("string", "boolean") else df.agg(F.avg(c)).first()[0])
    base |= at or {}
    if contrast:
        labels = list(contrast[1:])
        rows = [base | {contrast[0]: v} for v in labels]
    elif continuous:
        lo, hi = df.agg(F.min(continuous), F.max(continuous)).first()
        labels = np.linspace(lo, hi, npoints).tolist()
        rows = [base | {continuous: v} for v in labels]
    else:
        labels, rows = ["at"], [base]
    shape = ", ".join(f"`{c}` {kinds[c] if kinds[c] in ('string', 'boolean') else 'double'}" for c in columns)
    grid = df.sparkSession.createDataFrame([(i, *[r[c] if kinds[c] in ("string", "boolean") else float(r[c]) for c in columns]) for i, r in enumerate(rows)], f"_row int, {shape}")
    return labels, grid


def predicted_prevalence(theta: DataFrame, df: DataFrame, formula: str, at: dict | None = None, contrast: tuple | None = None, continuous: str | None = None, npoints: int = 20, n_sim: int = 1000, ci: float = 0.95, link: str = "identity", seed: int = 0) -> DataFrame:
    """(topic, at, estimate, low, high): fitted shares on a grid, with bands from simulated coefficients; for a contrast also its difference."""
    x, design = design_matrix(formula, df, "doc_id")
    labels, grid = reference_rows(df, design, at, contrast, continuous, npoints)
    rows = design.apply(grid, "_row").orderBy("_row").collect()
    m = np.array([[1.0, *[r[n] for n in design.names]] for r in rows])
    back = {"identity": lambda e: e, "logit": lambda e: 1 / (1 + np.exp(-e)), "log": np.exp}[link]
    out, rng, tail = [], np.random.default_rng(seed), (1 - ci) / 2
    for f in fit_effects(theta, x, design.names, link=link):
        sims = back(rng.multivariate_normal(f.coef, f.cov, n_sim, method="svd") @ m.T)
        point = back(m @ f.coef)
        if contrast:
            sims, point = np.c_[sims, sims[:, 1] - sims[:, 0]], np.r_[point, point[1] - point[0]]
        low, high = np.quantile(sims, [tail, 1 - tail], axis=0)
        out += [(f.topic, str(a), float(p), float(lo), float(hi)) for a, p, lo, hi in zip([*labels, "difference"], point, low, high)]
    return theta.sparkSession.createDataFrame(out, f"topic {dict(theta.dtypes)['topic']}, at string, estimate double, low double, high double")
