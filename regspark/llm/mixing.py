"""Mixing sources to target weights: soft domain membership and projected-gradient rates.

1. A labelled table gives the domain of some documents; half of them (by a hash) train, the others calibrate.
   On a bounded sample (``per_domain`` labelled documents of each domain) the ``features`` most telling words and shape
   marks are counted, and a logistic regression over those that occur is fitted.
2. Every document gets posteriors of the domains; they are rounded to a grid of ``grid`` steps, whose cells share a
   rate. A cell's membership is calibrated: the domains of all calibrating documents in it, to which
   the classifier's own mean counts as ``trust`` documents. Tokens and expected tokens per domain are summed per cell.
3. Rates of the cells, r >= 0, minimise
   ``sum_d w_d ((sum_c r_c E_cd - target_d) / total)^2 + pull * sum_c (T_c / total) (r_c - a_c)^2``
   by accelerated projected gradient steps over the cells, each one aggregation, until no rate moves by more than
   ``tolerance``. ``a_c`` is what membership alone gives, the mean of target / tokens over the cell's domains, so a document that
   is hardly toxic is not dropped for the rest of toxic tokens that membership cannot tell apart.
   ``w_d`` is 1 / share of the target (at most ``most_weight``), 1 for a target of 0.
4. A document's copies are its rate rounded up or down by a hash of its id and text, so
   expected totals are kept. ``mix_totals`` reports what is reached, ``kept_share`` what becomes of labelled documents.

All steps are DataFrame functions. Defined cases: null text has no tokens and prior
posteriors; a document labelled twice has its largest label; labels that are null or whose
document is missing do not count; without any label there is one domain, ``all``; repeated
rows get equal rates and copies; texts of any length count whole; an empty table gives an empty result; clashing names
of further columns do not matter as working columns carry the prefix ``_m_``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import bounded_sample, store

JUNK = "#*$%&|<>"
MAX_BROADCAST = 100_000  # cells whose rates are broadcast; more are joined
MAX_DOMAINS = 50
STEPS_STORED = 8  # steps between written rates


@dataclass(frozen=True)
class MixConfig:
    """Bounds of the sample and the model, target shares of tokens and the size of the mix."""

    per_domain: int = 1000
    features: int = 300
    least_share: float = 0.02  # of a domain's sample that must hold a feature
    least_ratio: float = 3.0  # between the domains' shares
    ridge: float = 0.0005
    fit_steps: int = 2000
    grid: int = 20
    trust: float = 2.0  # documents that the classifier's own posterior counts for in a cell
    pull: float = 0.05
    most_weight: float = 10.0
    tolerance: float = 1e-5  # of a rate
    budget: float = 1.1  # tokens of the mix as a multiple of the tokens there are
    shares: dict = field(default_factory=lambda: {"clean": 0.97, "poor": 0.03, "toxic": 0.0})


def domains(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(_m_id, _m_domain) of the labelled documents: toxic, else clean or poor by quality."""
    one = (labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_m_id"))
           .agg(F.max("quality").alias("q"), F.max("toxic").alias("t")))
    return (one.select("_m_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "clean")
                       .when(F.col("q") == 0, "poor").alias("_m_domain")).filter("_m_domain is not null"))


def calibrates(key: Column) -> Column:
    """Whether a labelled document is kept from training, to calibrate."""
    return F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)) == 1


def with_words(rows: DataFrame, text: str) -> DataFrame:
    """Adds _m_words (lower case, without punctuation) and _m_marks, which tell a text's shape: its share
    of junk characters, its length and its share of distinct words."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(F.lower(whole), r"[\s.,;:!?\"()#*$%&|<>]+", -1), lambda w: w != "")
    size = F.length(whole)
    junk = F.ceil(40 * (size - F.length(F.translate(whole, JUNK, ""))) / F.greatest(size, F.lit(1)))
    rows = rows.withColumn("_m_words", words).withColumn("_m_junk", F.least(F.lit(5), junk))
    n = F.greatest(F.size("_m_words"), F.lit(1))
    levels = {"junk": F.col("_m_junk"), "size": F.floor(F.log2(n)),
              "distinct": F.floor(10 * F.size(F.array_distinct("_m_words")) / n)}
    return rows.withColumn("_m_marks", F.array(*[F.format_string(f"<{k} %d>", v.cast("int")) for k, v in levels.items()]))


def train(docs: DataFrame, labelled: DataFrame, cfg: MixConfig, key: str, text: str) -> dict:
    """The classifier as plain numbers: domains, base scores and per feature weights."""
    rows = docs.select(docs[key].alias("_m_id"), docs[text].alias("_m_text")).filter("_m_id is not null")
    known = (rows.select("_m_id").distinct().join(labelled.filter(~calibrates(F.col("_m_id"))), "_m_id")
             .withColumn("_m_order", F.xxhash64("_m_id")))
    ids = bounded_sample(known, "_m_domain", "_m_order", cfg.per_domain, MAX_DOMAINS)
    picked = store(ids.select("_m_id", "_m_domain"), "mix-sample")
    sizes = {r[0]: r[1] for r in picked.groupBy("_m_domain").count().collect()}
    prior = {r[0]: r[1] for r in known.groupBy("_m_domain").count().collect()}
    names = sorted(sizes)
    if not names:
        return {"domains": ["all"], "base": [0.0], "weights": {}}
    sample = rows.join(F.broadcast(picked), "_m_id")  # at most per_domain ids a domain
    features = with_words(sample, "_m_text").select(
        "_m_domain", F.explode(F.array_distinct(F.concat("_m_words", "_m_marks"))).alias("f"))
    counted = features.groupBy("f").pivot("_m_domain", names).agg(F.count("f")).fillna(0)

    def share(d):
        return (F.col(f"`{d}`") + 0.5) / (sizes[d] + 1.0)

    low, high = (f(*[share(d) for d in names], F.lit(start)) for f, start in ((F.least, 1.0), (F.greatest, 0.0)))
    best = (counted.withColumn("gap", high - low).filter((high >= cfg.least_share) & (high >= cfg.least_ratio * low))
            .orderBy(F.desc("gap"), "f").limit(cfg.features).collect()) if len(names) > 1 else []
    names_of = [r["f"] for r in best]
    found = with_words(sample, "_m_text").select("_m_domain", F.array_intersect(
        F.concat("_m_words", "_m_marks"), F.array(*[F.lit(f) for f in names_of]).cast("array<string>")).alias("f")).collect()
    base, weight = fitted(found, names, names_of, cfg)
    seen, drawn = sum(prior.values()), sum(sizes.values())  # the sample holds a domain's documents up to a bound
    base = [b + math.log(prior[d] / seen) - math.log(sizes[d] / drawn) for b, d in zip(base, names, strict=True)]
    return {"domains": names, "base": base, "weights": {f: w.tolist() for f, w in zip(names_of, weight, strict=True)}}


def fitted(rows: list, names: list[str], features: list[str], cfg: MixConfig) -> tuple[list[float], np.ndarray]:
    """Intercepts and weights of a multinomial logistic regression with a ridge, by accelerated gradient steps over the
    bounded sample's rows (domain, features that occur). Common weak features do not add up, as each weight is fitted beside the others."""
    at = {f: i for i, f in enumerate(features)}
    x = np.zeros((len(rows), len(features) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r["f"]]] = 1
    y = np.array([[r["_m_domain"] == d for d in names] for r in rows], float)
    ridge = np.full((len(features) + 1, 1), cfg.ridge)
    ridge[-1] = 1e-6
    rate = 1 / (0.5 * np.linalg.eigvalsh(x.T @ x / len(x))[-1] + cfg.ridge)
    w = ahead = np.zeros((len(features) + 1, len(names)))
    for step in range(cfg.fit_steps):
        z = x @ ahead
        e = np.exp(z - z.max(1, keepdims=True))
        before, w = w, ahead - rate * (x.T @ (e / e.sum(1, keepdims=True) - y) / len(x) + ridge * ahead)
        ahead = w + step / (step + 3) * (w - before)
    return w[-1].tolist(), w[:-1]


def _score(model: dict) -> Column:
    """Log scores by domain from _m_words and _m_marks; only features that occur count."""
    start = F.array(*[F.lit(float(b)) for b in model["base"]])
    if not model["weights"]:
        return start
    found = F.array_intersect(F.concat("_m_words", "_m_marks"), F.array(*[F.lit(f) for f in model["weights"]]))
    table = F.create_map(*[x for f, w in model["weights"].items()
                           for x in (F.lit(f), F.array(*[F.lit(float(v)) for v in w]))])
    return F.aggregate(found, start, lambda a, f: F.zip_with(a, table[f], lambda x, y: x + y))


def soft(docs: DataFrame, model: dict, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, _m_tokens and _m_p (posteriors)."""
    rows = with_words(docs, text).select(*[F.col(f"`{c}`") for c in keep],
                                         F.size("_m_words").cast("long").alias("_m_tokens"), _score(model).alias("_m_s"))
    top = F.array_max("_m_s")
    rows = rows.withColumn("_m_e", F.transform("_m_s", lambda s: F.exp(s - top)))
    total = F.aggregate("_m_e", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("_m_p", F.transform("_m_e", lambda x: x / total)).drop("_m_s", "_m_e")


def cell_of(cfg: MixConfig) -> Column:
    return F.transform("_m_p", lambda p: F.round(p * cfg.grid).cast("int"))


def _targets(names: list[str], cfg: MixConfig, total: float) -> list[float]:
    target = [cfg.budget * total * cfg.shares.get(d, 0.0) for d in names]
    return target if any(target) else [cfg.budget * total / len(names)] * len(names)


def fit_rates(cells: DataFrame, names: list[str], cfg: MixConfig) -> DataFrame:
    """(cell, rate) of the cells (cell, tokens, p_0, p_1, ...): the least-squares optimum.

    The gradient is scaled by a cell's tokens, so its steepest curvature is the largest eigenvalue of the weighted k x k
    matrix of memberships, and its least is ``pull``; these set the step and the momentum.
    """
    k = len(names)
    p = [F.col(f"p_{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = cells.agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g_{i}_{j}") for i, j in pairs],
                     *[F.sum(F.col("tokens") * p[i]).alias(f"e_{i}") for i in range(k)]).first()
    total = float(sums["t"] or 0)
    if not total:
        return cells.select("cell", F.lit(1.0).alias("rate"))
    aim = np.array(_targets(names, cfg, total)) / total
    held = np.array([sums[f"e_{i}"] for i in range(k)]) / total
    weight = np.where(aim > 0, np.minimum(1 / np.maximum(aim, 1e-12), cfg.most_weight), 1.0)
    g = np.array([[sums[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    root = np.sqrt(weight)
    steep = float(np.linalg.eigvalsh(root[:, None] * g * root[None, :])[-1]) + cfg.pull
    momentum = (math.sqrt(steep) - math.sqrt(cfg.pull)) / (math.sqrt(steep) + math.sqrt(cfg.pull))
    ratio = [float(a / h) if h > 0 else 0.0 for a, h in zip(aim, held, strict=True)]
    anchor = sum((F.lit(x) * c for x, c in zip(ratio, p, strict=True)), F.lit(0.0))
    state = store(cells.select("cell", "tokens", *p, anchor.alias("a"), anchor.alias("r"), anchor.alias("y"),
                               F.lit(math.inf).alias("moved")), "mix-steps")
    step = 0
    while True:
        now = state.agg(F.max("moved").alias("moved"), *[F.sum(F.col("tokens") * F.col("y") * c).alias(f"e_{i}") for i, c in enumerate(p)]).first()
        if now["moved"] <= cfg.tolerance:
            return state.select("cell", F.col("r").alias("rate"))
        miss = [float(weight[i] * (now[f"e_{i}"] / total - aim[i])) for i in range(k)]
        slope = sum((F.lit(m) * c for m, c in zip(miss, p, strict=True)), F.lit(cfg.pull) * (F.col("y") - F.col("a")))
        after = state.withColumn("n", F.greatest(F.lit(0.0), F.col("y") - slope / F.lit(steep)))
        state = after.select("cell", "tokens", *p, "a", F.col("n").alias("r"), (F.col("n") + F.lit(momentum) * (F.col("n") - F.col("r"))).alias("y"),
                             F.abs(F.col("n") - F.col("y")).alias("moved"))
        step += 1
        if step % STEPS_STORED == 0:
            state = store(state, "mix-steps")


def reached(cells: DataFrame, rate_of: DataFrame, names: list[str], cfg: MixConfig) -> DataFrame:
    """(domain, tokens, target, reached): expected tokens there are, are aimed at and are in the mix."""
    k = len(names)
    expected = [F.col("tokens") * F.col(f"p_{i}") for i in range(k)]
    s = cells.join(rate_of, "cell").agg(F.sum("tokens").alias("t"), *[F.sum(x).alias(f"e_{i}") for i, x in enumerate(expected)],
                                        *[F.sum(F.col("rate") * x).alias(f"r_{i}") for i, x in enumerate(expected)]).first()
    target = _targets(names, cfg, float(s["t"] or 0))
    rows = [(d, float(s[f"e_{i}"] or 0), target[i], float(s[f"r_{i}"] or 0)) for i, d in enumerate(names)]
    return cells.sparkSession.createDataFrame(rows, "domain string, tokens double, target double, reached double")


def calibrated(lean: DataFrame, labelled: DataFrame, names: list[str], cfg: MixConfig) -> DataFrame:
    """(cell, tokens, p_0, p_1, ...): the tokens of each cell and its membership, from the calibrating documents in it."""
    k = len(names)
    sums = lean.groupBy(F.col("_m_cell").alias("cell")).agg(
        F.sum("_m_tokens").alias("tokens"), *[F.avg(F.col("_m_p")[i]).alias(f"q_{i}") for i in range(k)])
    if labelled is None:
        return sums.select("cell", "tokens", *[F.col(f"q_{i}").alias(f"p_{i}") for i in range(k)])
    held = labelled.filter(calibrates(F.col("_m_id")))
    places = lean.select(F.col("_m_key").alias("_m_id"), "_m_cell").distinct()  # a row a document, however often it repeats
    known = (places.join(held, "_m_id").groupBy(F.col("_m_cell").alias("at"))
             .agg(F.count("*").alias("n"), *[F.count_if(F.col("_m_domain") == d).alias(f"n_{i}") for i, d in enumerate(names)]))
    n = F.coalesce("n", F.lit(0))
    share = [(F.coalesce(f"n_{i}", F.lit(0)) + cfg.trust * F.col(f"q_{i}")) / (n + cfg.trust) for i in range(k)]
    return sums.join(known, F.col("cell") == F.col("at"), "left").select("cell", "tokens", *[x.alias(f"p_{i}") for i, x in enumerate(share)])


def _cells(docs: DataFrame, labels: DataFrame, cfg: MixConfig, key: str, text: str) -> tuple[dict, DataFrame, DataFrame]:
    """(model, documents, cells): stored _m_key, _m_hash, _m_tokens, _m_p, _m_cell of every row; tokens and membership per cell."""
    labelled = domains(labels)
    model = train(docs, labelled, cfg, key, text)
    own = F.xxhash64(docs[key], docs[text]).alias("_m_hash")
    rows = docs.select(docs[key].alias("_m_key"), docs[text].alias("_m_text"), own)
    lean = store(soft(rows, model, ["_m_key", "_m_hash"], "_m_text").withColumn("_m_cell", cell_of(cfg)), "mix-posteriors")
    known = labelled if model["domains"] != ["all"] else None
    return model, lean, store(calibrated(lean, known, model["domains"], cfg), "mix-cells")


def rates(docs: DataFrame, labels: DataFrame, cfg: MixConfig, key: str, text: str) -> tuple[dict, DataFrame, DataFrame]:
    """(model, documents, rates): the documents of ``_cells``; tokens, membership and rate per cell."""
    model, lean, cells = _cells(docs, labels, cfg, key, text)
    return model, lean, store(cells.join(fit_rates(cells, model["domains"], cfg), "cell"), "mix-rates")


def mix_totals(docs: DataFrame, labels: DataFrame, cfg: MixConfig = MixConfig(), key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """One row per domain: its expected tokens, its target and what the rates reach."""
    model, _, cells = _cells(docs, labels, cfg, key, text)
    return reached(cells, store(fit_rates(cells, model["domains"], cfg), "mix-rates"), model["domains"], cfg)


def kept_share(report: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(domain, calibrating, documents, as_domain, dropped, copies): what a ``mix_report`` does with the labelled documents
    of each domain, those that trained and those kept from training."""
    known = report.join(domains(labels, key).withColumnRenamed("_m_id", key).withColumnRenamed("_m_domain", "_m_true"), key)
    return known.groupBy(F.col("_m_true").alias("domain"), calibrates(F.col(key)).alias("calibrating")).agg(
        F.count("*").alias("documents"), F.count_if(F.col("_m_true") == F.col("domain")).alias("as_domain"),
        F.count_if(F.col("copies") == 0).alias("dropped"), F.sum("copies").alias("copies"))


def with_copies(rows: DataFrame, rate_of: DataFrame) -> DataFrame:
    """Adds _m_rate, _m_m (membership) and _m_copies; up to ``MAX_BROADCAST`` cells (counted) are broadcast."""
    share = F.pmod("_m_hash", F.lit(1_000_003)) / 1_000_003.0
    members = F.array(*[F.col(c) for c in rate_of.columns if c.startswith("p_")])
    named = rate_of.select(F.col("cell").alias("_m_cell"), F.col("rate").alias("_m_rate"), members.alias("_m_m"))
    if rate_of.count() <= MAX_BROADCAST:
        named = F.broadcast(named)
    return rows.join(named, "_m_cell", "left").withColumn("_m_copies", F.floor(F.col("_m_rate") + share).cast("long"))


def mix_report(docs: DataFrame, labels: DataFrame, cfg: MixConfig = MixConfig(), key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, domain (the likeliest), its calibrated posterior, rate, copies."""
    model, lean, rate_of = rates(docs, labels, cfg, key, text)
    best = F.array_max("_m_m")
    names = F.array(*[F.lit(d) for d in model["domains"]])
    return with_copies(lean, rate_of).select(
        F.col("_m_key").alias(key), F.col("_m_tokens").alias("n_tokens"),
        F.element_at(names, F.array_position("_m_m", best).cast("int")).alias("domain"),
        best.alias("posterior"), F.col("_m_rate").alias("rate"), F.col("_m_copies").alias("copies"))


def resample(docs: DataFrame, labels: DataFrame, cfg: MixConfig = MixConfig(), key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The documents as often as their copies say, columns as they were."""
    _, lean, rate_of = rates(docs, labels, cfg, key, text)
    copies = (with_copies(lean, rate_of).filter("_m_copies > 0")
              .groupBy("_m_hash").agg(F.min("_m_copies").cast("int").alias("_m_copies")))
    return (docs.withColumn("_m_hash", F.xxhash64(docs[key], docs[text])).join(copies, "_m_hash")
            .withColumn("_m_i", F.explode(F.sequence(F.lit(1), F.col("_m_copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
