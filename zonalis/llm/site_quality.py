"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

A logistic model of text counts gives each document's evidence. Sites (``host``) and their sections (``path``
within the site) get posterior means of that evidence: a section's mean is shrunk to its site's, a site's to the
global mean, the more the fewer documents it has and the less sites differ. A document's quality adds to its own
log odds the shift that its section's posterior makes against the global mean. A section's mean contains the
document's own evidence, once among all its documents', as a group mean does in empirical Bayes: for a section of one
document the shrinkage leaves little of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.profiles import DIGIT, JOINT, OTHER, STOP, SYMBOL, UPPER, profile, total_of
from zonalis.runtime import broadcast_if_small, cut

#: Labelled rows that the model is fitted on at most, those with the smallest id hashes.
FIT_ROWS = 20_000
RIDGE = 1.0
KEEP_FROM = 0.5
#: Weight of the section's shift against the document's own log odds.
SITE_WEIGHT = 1.0
FEATURES = 10
#: Sections, of some 100 bytes each, go to every task up to so many; more are joined by shuffle.
BROADCAST_SECTIONS = 20_000


def features() -> Column:
    """Numbers of a profile() row that tell good text from junk, each of the order of 1."""
    chars = F.greatest("n_chars", F.lit(1)).cast("double")
    words = F.greatest("n_words", F.lit(1)).cast("double")
    at = lambda i: 10.0 * F.col("classes")[i] / chars
    common = total_of(F.col("common")) / words
    return F.array(at(UPPER), at(DIGIT), at(STOP), at(SYMBOL), at(OTHER) + at(JOINT), common, F.col("n_repeat_words") / words, F.log1p("n_words") / 5.0, F.col("word_chars") / words / 5.0, F.log1p("n_dup_lines"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> np.ndarray:
    """Ridge logistic weights by Newton steps, the intercept last and unpenalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(profiled: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS) -> np.ndarray:
    """Weights from a bounded sample of labelled rows; without two classes, the evidence is the share of good ones.

    An id that is labelled both ways counts as 0; of rows that share an id, the one of smallest features is taken. So
    the sample has ``rows`` rows at most, the same ones in every run.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"))
    chosen = known.orderBy(F.xxhash64(id_col, F.lit("fit")), id_col).limit(rows)
    sample = profiled.join(chosen, id_col).groupBy(id_col).agg(F.min(F.struct(features().alias("x"), "y")).alias("r")).orderBy(id_col).select("r.*").collect()
    x, y = np.array([r["x"] for r in sample], float).reshape(-1, FEATURES), np.array([r["y"] for r in sample], float)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return np.array([0.0] * FEATURES + [np.log(share / (1 - share))])
    return fit_logistic(x, y)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _shrunk(sums: DataFrame, prior: Column, name: str, inner: Column | None = None) -> DataFrame:
    """Adds ``name``: each group's mean of ``s`` over ``n`` rows, shrunk to ``prior``.

    The prior's weight in documents is within-group variance over between-group variance, the latter by the
    method of moments over all groups: two sums for the driver, whatever the number of groups.
    """
    d = F.col("s") / F.col("n") - prior
    within = F.greatest(F.col("s2") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))
    row = sums.agg(F.sum(F.col("n") * d * d).alias("between"), F.sum(F.col("n") * within).alias("within"), F.sum("n").alias("rows"), F.count("*").alias("groups")).first()
    if not row["rows"]:
        return sums.withColumn(name, prior)
    inside = row["within"] / max(row["rows"] - row["groups"], 1)
    across = max((row["between"] - inside * row["groups"]) / row["rows"], 1e-6)
    weight = float(min(max(inside / across, 1.0), 1e6))
    return sums.withColumn(name, (F.col("s") + weight * prior) / (F.col("n") + weight))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", rows: int = FIT_ROWS) -> DataFrame:
    """``(id, evidence, host_posterior, path_posterior, quality, kept)`` of every row.

    NULL hosts and paths are groups of their own; NULL and empty texts get the evidence of a text without words.
    Repeated rows and NULL ids come back as they came; NULL labels are left out of the fit. An empty table gives
    no rows. Groups are folded by partial sums before they meet, and their posteriors are joined back by a join
    that Spark may split, so a host with a third of all rows does no harm.
    """
    counted = cut(profile(docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{host}`").alias("__host"), F.col(f"`{path}`").alias("__path"), F.col(f"`{text}`").alias("text")), keep=(id_col, "__host", "__path")))
    w = fit(counted, labels, id_col, label, rows)
    odds = F.aggregate(F.zip_with(features(), F.array(*[F.lit(float(v)) for v in w[:-1]]), lambda a, b: a * b), F.lit(float(w[-1])), lambda a, x: a + x)
    judged = counted.select(id_col, "__host", "__path", (1 / (1 + F.exp(-odds))).alias("evidence"))
    sums = [F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("s2")]
    paths = cut(judged.groupBy("__host", "__path").agg(*sums))
    hosts = paths.groupBy("__host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")])
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    overall = float(total[0] / total[1]) if total[1] else 0.5
    hosts = _shrunk(cut(hosts), F.lit(overall), "host_posterior").select(F.col("__host").alias("h"), "host_posterior")
    joined = paths.join(hosts, F.col("__host").eqNullSafe(F.col("h"))).drop("h")
    sections = _shrunk(cut(joined), F.col("host_posterior"), "path_posterior")
    sections = sections.select(F.col("__host").alias("h"), F.col("__path").alias("p"), "host_posterior", "path_posterior")
    sections = broadcast_if_small(cut(sections), BROADCAST_SECTIONS)
    out = judged.join(sections, F.col("__host").eqNullSafe(F.col("h")) & F.col("__path").eqNullSafe(F.col("p")))
    shift = SITE_WEIGHT * (_logit(F.col("path_posterior")) - _logit(F.lit(overall)))
    quality = 1 / (1 + F.exp(-(_logit(F.col("evidence")) + shift)))
    return out.select(id_col, "evidence", "host_posterior", "path_posterior", quality.alias("quality")).withColumn("kept", F.col("quality") >= KEEP_FROM)
