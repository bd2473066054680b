"""Document quality by hierarchical empirical Bayes over document, path and host."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelayout.llm.common import column, cut, small, wrap

SAMPLE = 20_000  # labelled rows that the document classifier is fitted on, at most
MOST_SITES = 100_000  # rows of the site table that are broadcast, at most
NAMES = ["shouted", "marks", "digits", "stops", "lines", "capitals", "length", "words"]
# Classes of characters, one bit each.
UPPER, LOWER, MARK, DIGIT, STOP, LINE, WHITE, WORD = (1 << i for i in range(8))
MARKS, STOPS, SPACES = "*#$%&!|~^=_<>[]{}\\/@+", ".,;:?", " \t\n\x0b\f\r"
TOP = 0x20000  # no cased letters, digits or marks from here on
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The classes of every code point below ``TOP``, and of all others in the last place."""
    if not _CLASSES:
        table = np.zeros(TOP + 1, dtype=np.uint8)
        for i in range(TOP):
            c = chr(i)
            kind = unicodedata.category(c)
            table[i] = UPPER * (kind == "Lu") | LOWER * (kind == "Ll") | WORD * (c.isalnum() or c == "_")
        table[TOP] = WORD
        for bit, chars in ((MARK, MARKS), (STOP, STOPS), (LINE, "\n"), (WHITE, SPACES), (DIGIT, "0123456789")):
            table[[ord(c) for c in chars]] |= bit
        _CLASSES.append(table)
    return _CLASSES[0]


def text_features(text: str | None) -> list[float] | None:
    """``NAMES`` of a text; none without words.

    Per word (cut at ASCII white space): runs of two or more capitals, of marks and of digits, stops, line ends, and words
    that begin with one capital; then characters per word and words. All as log(1 + x).
    """
    if not text:
        return None
    code = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), TOP)
    kind = np.zeros(len(code) + 2, dtype=np.uint8)  # nothing on both sides
    kind[0] = kind[-1] = WHITE
    kind[1:-1] = _classes()[code]
    before, here, after = kind[:-2], kind[1:-1], kind[2:]

    def runs(bit: int) -> int:
        return np.count_nonzero(here & ~before & bit)

    words = np.count_nonzero(~here & before & WHITE)
    if not words:
        return None
    shouted = np.count_nonzero(here & after & ~before & UPPER)
    capitals = np.count_nonzero((here & UPPER).astype(bool) & (after & LOWER).astype(bool) & ~(before & WORD).astype(bool))
    counts = np.array([shouted, runs(MARK), runs(DIGIT), np.count_nonzero(here & STOP), np.count_nonzero(here & LINE), capitals, len(code)])
    return [*np.log1p(counts / words), np.log1p(words)]


def features(text: Column) -> Column:
    """array<double> of ``NAMES``; null for a text without words. One text at a time is taken apart, so memory follows the longest text."""

    @F.pandas_udf("array<double>")
    def taken(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_features(t) for t in texts], dtype=object)

    return taken(text)


@dataclass(frozen=True)
class Evidence:
    """A logistic classifier of texts; ``prior`` is the log-odds of the rows it was fitted on."""

    weights: tuple[float, ...]
    bias: float
    prior: float

    def log_odds(self, text: Column) -> Column:
        """Log-likelihood ratio of good against bad, 0 for a text without words."""
        terms = F.zip_with(features(text), F.array(*[F.lit(w) for w in self.weights]), lambda x, w: x * w)
        return F.coalesce(F.aggregate(terms, F.lit(self.bias - self.prior), lambda a, x: a + x), F.lit(0.0))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> Evidence:
    """Newton's method on standardised features."""
    if len(y) == 0 or y.min() == y.max():
        return Evidence((0.0,) * len(NAMES), 0.0, 0.0)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * len(y) * np.r_[w[:-1], 0] / 100
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)) * (ridge * len(y) / 100 + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    own = w[:-1] / scale
    rate = y.mean()
    return Evidence(tuple(float(v) for v in own), float(w[-1] - own @ mean), float(np.log(rate / (1 - rate))))


def fit_evidence(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Evidence:
    """Fit the classifier on at most ``sample`` labelled rows, chosen by a hash of their id; no usable label, no evidence."""
    chosen = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id").where(F.col("t").rlike(r"\S")).limit(2 * sample)
    rows = found.select(features(F.col("t")).alias("x"), "y").collect()  # bounded by the sample; repeated ids may double it
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows], dtype=float))


def _strength(level: Column, mean: Column, above: Column) -> list[Column]:
    """Aggregates for the strength of a prior: scatter of means around their parent against scatter inside."""
    return [F.sum(F.col("n") * (mean - above) ** 2).alias("between"), F.sum(F.col("ss") - F.col("s") ** 2 / F.col("n")).alias("within"), F.sum("n").alias("rows"), F.count(level).alias("groups"), F.sum(F.col("n").cast("double") ** 2).alias("nn")]


def _pseudo_rows() -> Column:
    """Rows that a prior is worth: variance inside groups over variance between them (method of moments)."""
    inside = F.col("within") / F.greatest(F.col("rows") - F.col("groups"), F.lit(1))
    between = (F.col("between") - (F.col("groups") - 1) * inside) / F.greatest(F.col("rows") - F.col("nn") / F.col("rows"), F.lit(1e-9))
    return F.least(F.greatest(F.when((between > 0) & (F.col("groups") > 1), inside / between).otherwise(F.lit(1e9)), F.lit(1.0)), F.lit(1e9))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, p) rows to one row per host and path: counts, sums, the posterior of its host and the strengths of both priors.

    A grouped aggregation with partial sums gives n, sum and sum of squares per (host, path), and these give those per host. Means
    of sparse hosts shrink toward the global mean, means of sparse paths toward their host's posterior.
    """
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("ss")))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    whole = hosts.agg((F.sum("s") / F.sum("n")).alias("mean"))
    host_prior = hosts.crossJoin(F.broadcast(whole)).groupBy("mean").agg(*_strength(F.lit(1), F.col("s") / F.col("n"), F.col("mean"))).select("mean", _pseudo_rows().alias("host_rows"))
    hosts = hosts.crossJoin(F.broadcast(host_prior)).select(
        F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), "mean", "host_rows", ((F.col("s") + F.col("host_rows") * F.col("mean")) / (F.col("n") + F.col("host_rows"))).alias("host_posterior")
    )
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    path_prior = paths.agg(*_strength(F.lit(1), F.col("s") / F.col("n"), F.col("host_s") / F.col("host_n"))).select(_pseudo_rows().alias("path_rows"))
    return cut(paths.crossJoin(F.broadcast(path_prior)))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, threshold: float = 0.5, label: str = "quality") -> DataFrame:
    """Every document with its evidence, the posteriors of host and path, and the decision.

    ``row``, evidence (log-likelihood ratio of the text), host_posterior, site_posterior (path within host, without the document
    itself), score (posterior probability of being good), keep (score at least ``threshold``).

    A text that is null or has no words brings no evidence and follows its site. Null hosts and paths are sites of their own. Without labels
    of both kinds there is no evidence and everything is kept. Repeated ids and rows are scored one by one.
    """
    model = fit_evidence(docs, labels, sample, doc_id, text, label)
    rows = wrap(docs)
    rows = rows.select("row", column(host).cast("string").alias("host"), column(path).cast("string").alias("path"), model.log_odds(column(text)).alias("evidence"))
    rows = rows.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + F.lit(model.prior)))))
    sites = small(site_posteriors(rows.select("host", "path", "p")).withColumnsRenamed({"host": "site_host", "path": "site_path"}), MOST_SITES)
    rows = rows.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    others_host = (F.col("host_s") - F.col("p") + F.col("host_rows") * F.col("mean")) / (F.col("host_n") - 1 + F.col("host_rows"))
    rows = rows.withColumn("prior", others_host)
    others = (F.col("s") - F.col("p") + F.col("path_rows") * F.col("prior")) / (F.col("n") - 1 + F.col("path_rows"))
    rows = rows.withColumn("site_posterior", F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6)))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("site_posterior") / (1 - F.col("site_posterior"))))))
    return rows.withColumn("score", score).select("row", "evidence", "host_posterior", "site_posterior", "score", (F.col("score") >= threshold).alias("keep"))
