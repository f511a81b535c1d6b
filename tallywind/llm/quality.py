"""Quality classifier: document evidence combined with host and path posteriors by
hierarchical empirical Bayes.

A logistic model on surface features, fitted to a bounded sample of labelled documents, gives
each document's log odds. Its probabilities, summed over all documents of a path, a host and
the corpus, give site rates: a host's rate is drawn to the global rate and a path's to its
host's by as many pseudo-documents as the spread of the rates between sites calls for (beta
moments, from grouped sums). A document's own probability is left out of the rates that judge
it. Its score is the model's log odds, moved by the path's log odds against the global ones.

Only sums per path are shuffled, combined on the map side, so a host with a third of all
documents is one row per task; site tables are joined back by Spark's size-checked broadcast or
a skew-split join.

Defined cases: null text is empty; an empty text shows no evidence, is judged by its site
alone and takes no part in the rates; null hosts and paths are sites of their own; repeated rows count as often as they
appear; labels that are null or of unknown documents are passed over; without both labels the
evidence is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_of

#: Labelled documents the model is fitted to, at most: those with the smallest hashes of their id.
SAMPLE = 20_000


def host_of(url: Column) -> Column:
    """Host of a URL, lower case, without port and user."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def features(text: Column) -> Column:
    """Surface features of a text, an array of doubles; null for an empty text."""
    n = F.length(text).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / n
    words = F.split(F.trim(text), r"[\x20\x09-\x0D]+")
    upper, symbols, digits = share(r"[^\p{Lu}]+"), share(r"[\p{L}\p{M}\p{N}\s.,;:'\"()\-]+"), share(r"[^0-9]+")
    count = F.size(words).cast("double")
    fresh = F.size(F.array_distinct(words)) / count
    lots = lambda x, at: F.greatest(F.lit(0.0), x - F.lit(at))
    few = F.least(F.lit(6.0), -F.log(fresh))
    return F.when(n > 0, F.array(
        symbols, F.sqrt(symbols), lots(symbols, 0.05), upper, F.sqrt(upper), lots(upper, 0.15), digits,
        few, few * F.log1p(count) / 10.0, lots(few, 1.5), F.log1p(count) / 10.0, F.least(n / count, F.lit(40.0)) / 10.0))


N_FEATURES = 12


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton's method; x without the constant, which comes first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def model(found: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray | None:
    """Weights from the labelled documents among ``found`` (doc_id, f); None without both labels."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = (found.select("doc_id", "f").filter("f IS NOT NULL").join(known, "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas())
    if rows["y"].nunique() < 2:
        return None
    return fit(np.array(rows["f"].tolist(), dtype=float), rows["y"].to_numpy(float))


def site_rates(scored: DataFrame) -> tuple[DataFrame, DataFrame, float, float, float]:
    """Sums per path and host of ``scored`` (host, path, p), the global rate, and the
    pseudo-documents of hosts (towards the global rate) and paths (towards their host's)."""
    paths = store(scored.groupBy("host", "path").agg(F.count("p").alias("n"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("s"),
                                                     F.coalesce(F.sum(F.col("p") * (1 - F.col("p"))), F.lit(0.0)).alias("v")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("v").alias("host_v"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    rate = float(total["s"] / total["n"]) if total["n"] else 0.5
    rate = min(max(rate, 1e-4), 1 - 1e-4)

    def pseudo(df: DataFrame, n: str, s: str, mean: Column) -> float:
        """Beta prior's weight whose variance is the rates' beyond what sampling alone gives."""
        n, r = F.col(n), F.col(s) / F.col(n)
        m = (df.filter(n > 1).agg(F.sum(n * (r - mean) ** 2).alias("between"), F.sum(mean * (1 - mean)).alias("within"),
                                  F.sum(n).alias("n")).first())
        if not m["n"]:
            return 100.0
        spread = (m["between"] - m["within"]) / m["n"]
        return float(min(max(rate * (1 - rate) / spread - 1, 1.0), 1e4)) if spread > 0 else 1e4

    k_host = pseudo(hosts, "host_n", "host_s", F.lit(rate))
    both = paths.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    k_path = pseudo(both, "n", "s", F.col("host_s") / F.col("host_n"))
    return paths, hosts, rate, k_host, k_path


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.3,
             sample: int = SAMPLE) -> DataFrame:
    """doc_id, host, path, evidence (log odds of the document alone), host_rate, path_rate
    (without the document itself), score (probability) and keep, a row per row of ``docs``."""
    found = store(docs.select("doc_id", host.alias("host"), path.alias("path"), features(text_of()).alias("f")), "quality-features")
    w = model(found, labels, sample=sample)
    odds = F.lit(0.0)
    if w is not None:
        odds = F.lit(float(w[0])) + sum((F.lit(float(c)) * F.col("f")[i] for i, c in enumerate(w[1:])), F.lit(0.0))
    prior = F.avg(F.when(F.col("f").isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))))
    base = found.agg(prior.alias("p")).first()["p"]
    base = min(max(base if base is not None else 0.5, 1e-4), 1 - 1e-4)
    none = float(np.log(base / (1 - base)))
    scored = found.select("doc_id", "host", "path", "f",
                          F.when(F.col("f").isNotNull(), F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))).otherwise(F.lit(none)).alias("evidence"))
    scored = scored.withColumn("p", F.when(F.col("f").isNotNull(), 1 / (1 + F.exp(-F.col("evidence"))))).drop("f")
    own, one = F.coalesce("p", F.lit(0.0)), F.col("p").isNotNull().cast("int")
    paths, hosts, rate, k_host, k_path = site_rates(scored)
    sites = store(paths.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
                  .select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "n", "s", "host_n", "host_s"), "quality-sites")
    host_rate = (F.col("host_s") - own + k_host * rate) / (F.col("host_n") - one + k_host)
    path_rate = (F.col("s") - own + k_path * F.col("host_rate")) / (F.col("n") - one + k_path)
    logit = lambda r: F.log(r / (1 - r))
    kept = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_rate")))
    return (scored.join(sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
            .withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
            .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + logit(kept) - F.lit(float(np.log(rate / (1 - rate))))))))
            .select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "score",
                    (F.col("score") >= threshold).alias("keep")))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents the classifier rejects. Rows with one doc_id stay or go
    together (they stay if one of them is kept); rows with null doc_id stay."""
    judged = classify(docs, labels, host, path, threshold, sample)
    bad = store(judged.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("keep").alias("keep")).filter("NOT keep").select("doc_id"), "quality-bad")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
