"""Quality classifier: hierarchical empirical Bayes over sites (operator 5).

1. A logistic model on counts of the whole text gives each document's evidence as log odds.
2. Grouped sums give each path (here: source and language) and each host (source) its count of rows and
   of good rows; a row counts by its label where it has one outside the held-out fold, else by the
   model's probability.
3. Hosts shrink toward the global rate, paths toward their host, by beta priors. How much follows from the
   spread of the rates between hosts, and between the paths of a host, beyond what chance gives (method of
   moments): no such spread, and all share one rate; a wide spread, and a site soon stands for itself. A prior
   weighs one row at least, so that no rate is 0 or 1.
4. A document's score adds the log odds of its path's posterior rate, without the document's own part in it, to
   its evidence: no weight or limit is set by hand. The cut is set on the histogram of all labelled training rows.

Bounds: the logistic model sees at most `sample` labelled rows (those of the smallest id hash outside the
held-out fold). The sums, the spreads, the cut and the scores cover every row. Sites are joined back by
broadcast only if they were counted to be few; otherwise by salted keys, so a hot host spreads.

Cases: null texts are empty and score like empty ones; null hosts and paths are sites of their own named
''; null ids are never labelled; repeated rows get equal scores; without labels of both kinds every score
is 0.5 and all rows are kept; columns beside those named are never read, results are in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_declared, bounded_join, fold, labels_of, logistic, materialise, sample_rows, skewed_join, table, threshold
from .textstats import text_stats

SAMPLE = 8000
BINS = 1000
FALSE_REJECT = 0.002
#: The least strength of a prior, in rows.
LEAST_STRENGTH = 1.0


def features(s: str) -> list[Column]:
    """Length-free ratios of the counts in struct column s, as built-in expressions."""
    c = lambda f: F.col(f"{s}.{f}").cast("double")
    words, chars, lines = (F.greatest(c(f), F.lit(1.0)) for f in ("n_words", "word_chars", "n_lines"))
    root = lambda a, b: F.sqrt(F.least(a / b, F.lit(1.0)))
    return [
        F.least(chars / words, F.lit(30.0)) / 10, root(c("n_symbols"), words), root(c("n_dup_lines"), lines), root(c("n_repeat_words"), words),
        root(c("n_upper"), chars), root(c("n_bang"), words), root(c("n_digits"), chars), root(c("n_ends"), lines),
        F.log1p(words) / 5, F.when(words < 50, 1.0).otherwise(0.0),
    ]


@dataclass
class Model:
    weights: list[float]
    base: float  # rate of good rows in the sample
    rate: float  # global rate over all rows
    host_pull: float  # one over the strength of a host's prior in rows: what a row weighs against it
    path_pull: float
    cut: int  # first rejected bin of 1 - score


def evidence(model: Model, stats: str) -> Column:
    """Log odds of the document's own text, without the sample's base rate."""
    x = reduce(lambda a, b: a + b, [f * F.lit(w) for f, w in zip(features(stats), model.weights)], F.lit(model.weights[-1]))
    return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x)) - F.lit(float(np.log(model.base / (1 - model.base))))


def logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def pull(groups: DataFrame) -> float:
    """One over the strength of the beta priors of groups within their parents, 0 to 1 / LEAST_STRENGTH.

    groups: n, k of each group, and n and k of its parent as parent, parent_n, parent_k. The squares of the rates
    around their parent's, weighted by rows, are (G - 1) p q for G groups by chance alone; the correlation of rows of
    one group adds p q (N - sum n^2 / N - (G - 1)) times itself. It is 1 / (1 + strength).
    """
    rate = F.col("k") / F.col("n")
    p = F.least(F.greatest(F.col("parent_k") / F.col("parent_n"), F.lit(1e-6)), F.lit(1 - 1e-6))
    each = groups.groupBy("parent", p.alias("p"), "parent_n").agg(F.count("*").alias("g"), F.sum(F.col("n") * F.pow(rate - p, 2)).alias("ss"), F.sum(F.pow(F.col("n").cast("double"), 2)).alias("nn"))
    pq = F.col("p") * (1 - F.col("p"))
    found = each.agg(F.sum(F.col("ss") - pq * (F.col("g") - 1)).alias("over"), F.sum(pq * (F.col("parent_n") - F.col("nn") / F.col("parent_n") - (F.col("g") - 1))).alias("room")).first()
    if not found.room or found.room <= 0 or found.over <= 0:
        return 0.0
    rho = min(found.over / found.room, 0.5)
    return float(min(rho / (1 - rho), 1 / LEAST_STRENGTH))


def prepared(docs: DataFrame, host: str, path: str) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.withColumn("__site", F.struct(name(host).alias("host"), name(path).alias("path"), text_stats(F.col("text").cast("string")).alias("stats")))


def chance(model: Model) -> Column:
    """The model's probability from the text alone, at the sample's base rate."""
    return 1 / (1 + F.exp(-(evidence(model, "__site.stats") + float(np.log(model.base / (1 - model.base))))))


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, false_reject: float = FALSE_REJECT, sites: bool = True) -> tuple[Model | None, DataFrame | None]:
    """The model and the table of paths (n, k, and those of their hosts); rows: a materialised table of doc_id and __site.

    sites=False: priors of endless strength, so that sites have no say (to measure what they do)."""
    known = labels_of(labels, "quality").where(fold() != 0)
    rows = rows.select("doc_id", "__site")
    labelled = rows.join(known, "doc_id")
    named = [f.alias(f"f{i}") for i, f in enumerate(features("__site.stats"))]
    got = sample_rows(labelled.select("doc_id", "__label", *named), ["__label", *[f"f{i}" for i in range(len(named))]], sample, "doc_id")
    y = np.array([r[0] for r in got], float)
    if not 0 < y.sum() < len(y):
        return None, None
    w = logistic(np.array([r[1:-1] for r in got], float), y)
    model = Model([float(v) for v in w], float(y.mean()), 0.5, 0.0, 0.0, BINS + 1)
    site = [F.col("__site.host").alias("__host"), F.col("__site.path").alias("__path")]
    # Null ids have no label; they stay out of the join, where they would meet in one task.
    parts = [rows.where("doc_id is not null").join(known, "doc_id", "left").select(*site, F.coalesce(F.col("__label").cast("double"), chance(model)).alias("good")),
             rows.where("doc_id is null").select(*site, chance(model).alias("good"))]
    paths = materialise(parts[0].unionByName(parts[1]).groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("good").alias("k")), "paths")
    hosts = materialise(paths.groupBy("__host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k")), "hosts")
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_k").alias("k")).first()
    model.rate = float(np.clip(total.k / total.n, 1e-3, 1 - 1e-3))
    paths = materialise(skewed_join(paths, materialise(hosts.join(paths.groupBy("__host").agg(F.count("*").alias("rows")), "__host"), "hosts"), "__host", "rows"), "sites")
    if sites:
        model.host_pull = pull(hosts.select(F.lit(0).alias("parent"), F.col("host_n").alias("n"), F.col("host_k").alias("k"), F.lit(total.n).alias("parent_n"), F.lit(total.k).alias("parent_k")))
        model.path_pull = pull(paths.select(F.col("__host").alias("parent"), "n", "k", F.col("host_n").alias("parent_n"), F.col("host_k").alias("parent_k")))
    bad = F.least(((1 - F.col("__quality.score")) * BINS).cast("int"), F.lit(BINS))
    hist = scored(labelled, model, paths, own=F.col("__label")).groupBy(bad.alias("bin")).agg(F.sum("__label").alias("good"), F.sum(1 - F.col("__label")).alias("bad")).collect()
    model.cut = threshold([tuple(r) for r in hist], BINS, false_reject)
    return model, paths


def scored(rows: DataFrame, model: Model | None, paths: DataFrame | None, out: str = "__quality", own: Column | None = None) -> DataFrame:
    """rows (with __site) and struct `out`: evidence, host_rate, path_rate, score, kept.

    own: what a row itself gave to the sums of its site, the model's probability unless it is said; it is taken out."""
    if model is None:
        half = F.lit(0.5)
        return rows.withColumn(out, F.struct(F.lit(0.0).alias("evidence"), half.alias("host_rate"), half.alias("path_rate"), half.alias("score"), F.lit(True).alias("kept")))
    sums = F.struct(*[F.col(c).cast("double").alias(c) for c in ("n", "k", "host_n", "host_k")])
    joined = bounded_join(rows.withColumn("__host", F.col("__site.host")).withColumn("__path", F.col("__site.path")), paths.select("__host", "__path", sums.alias("__sums")), ["__host", "__path"])
    own = chance(model) if own is None else own
    others = lambda n, k, pull, prior: (F.greatest(F.col(f"__sums.{k}") - own, F.lit(0.0)) * pull + prior) / ((F.col(f"__sums.{n}") - 1) * pull + 1)
    host = others("host_n", "host_k", model.host_pull, F.lit(model.rate))
    path = others("n", "k", model.path_pull, host)
    score = F.round(1 / (1 + F.exp(-(evidence(model, "__site.stats") + logit(path)))), 6)
    kept = F.least(((1 - score) * BINS).cast("int"), F.lit(BINS)) < model.cut
    result = F.struct(evidence(model, "__site.stats").alias("evidence"), host.alias("host_rate"), path.alias("path_rate"), score.alias("score"), kept.alias("kept"))
    return joined.withColumn(out, result).drop("__host", "__path", "__sums")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = materialise(prepared(docs, "source", "lang").select("doc_id", "__site"), "site-stats")
    return scored(rows, *fit(rows, table(spark, sf_dir, "labels"))).select(
        "doc_id", F.col("__site.host").alias("host"), F.col("__site.path").alias("path"), F.round("__quality.evidence", 6).alias("evidence"),
        F.round("__quality.host_rate", 6).alias("host_rate"), F.round("__quality.path_rate", 6).alias("path_rate"), "__quality.score", "__quality.kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with their columns as they were. The counts are made once, beside the rows."""
    rows = materialise(prepared(docs, "source", "lang"), "site-stats")
    model, paths = fit(rows, table(spark, sf_dir, "labels"))
    return as_declared(scored(rows, model, paths).where("__quality.kept"), docs.schema)
