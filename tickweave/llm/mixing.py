"""Mixing documents to target weights by soft domain membership.

A classifier fitted on a labelled table gives every document posteriors over domains. Document rates, none
negative, are then fitted so that expected tokens per domain, sum(rate * tokens * posterior), come as near to the
targets as they can (least squares), by projected gradients: one evaluation is one aggregation of sums over domains, and
rates follow by a column expression. Only those sums pass through the driver. Where targets are out of reach the
residual says so; mix() returns it with every row.

The classifier is naive Bayes over hashed word features (all those with clear evidence, SLOTS at most), tempered by the
number of features found so that long texts stay soft. It may be fitted on MAX_LABELLED labelled rows, which is a parameter.
Scoring covers every word of every document.

Tokens are counted by a column that the caller may give (ids of a tokenizer, say); by default they are words, so
that the main path stays in SQL functions.

Defined results: very long texts are read in whole; a null or empty text has no tokens, prior posteriors and the rate its posteriors give; a
document labelled repeatedly counts once, at the least label; repeated rows are rated alike; an empty table
gives no rows; without labels there is one domain, "all". Clashing further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.base import once, small_side, staged, text_of, words_of

MAX_LABELLED = 20_000
SLOTS = 1 << 15
MIN_Z, MIN_ODDS = 5.0, 2.5
#: Of the totals' distance from the targets that is as good as none; of the squared distance by which a smaller pull must still improve it.
TOLERANCE, GAIN = 1e-4, 1e-4


def slots(words: Column) -> Column:
    """Hashed features of a text: distinct slots of its words, and the tenths of its words that are all
    capitals, end in a sign, or repeat the word before."""
    place = lambda x: F.pmod(x, F.lit(SLOTS)).cast("int")
    share = lambda ws, name, test: place(F.xxhash64(F.lit(name), F.floor(10 * F.size(F.filter(ws, test)) / F.greatest(F.size(ws), F.lit(1)))))

    def found(ws: Column) -> Column:
        shapes = F.array(
            share(ws, "capitals", lambda w: (F.upper(w) == w) & (F.lower(w) != w)),
            share(ws, "signs", lambda w: ~F.right(w, F.lit(1)).rlike(r"[\p{L}\p{N}.,]")),
            share(ws, "repeats", lambda w, i: F.coalesce(F.get(ws, i - 1) == w, F.lit(False))))
        return F.array_distinct(F.concat(F.transform(ws, lambda w: place(F.xxhash64(F.lower(w)))), shapes))

    return once(words, found)


def fit_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> dict:
    """labels: doc_id, domain. A model of bounded size: domains, log priors, and per domain sparse log-odds by slot."""
    known = labels.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id")
    own = staged(own.select("domain", slots(words_of(F.col("text"))).alias("slots")), "labelled")
    sizes = {r["domain"]: r["n"] for r in own.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain").collect()}  # of at most max_rows rows
    if not sizes:
        return {"domains": ["all"], "priors": [0.0], "odds": [{}]}
    total, domains = sum(sizes.values()), list(sizes)
    # Evidence of a slot for a domain: its share of documents there against all others, by a two-sample z.
    counts = own.select("domain", F.explode("slots").alias("slot")).groupBy("domain", "slot").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("slot").agg(F.sum("n").alias("all"))
    inside = F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(float(sizes[d])))])[F.col("domain")]
    outside = F.lit(float(total)) - inside
    p, q = (F.col("n") + 0.5) / (inside + 1), (F.col("all") - F.col("n") + 0.5) / (outside + 1)
    both = (F.col("all") + 0.5) / (total + 1)
    z = (p - q) / F.sqrt(both * (1 - F.least(both, F.lit(0.999))) * (1 / (inside + 1) + 1 / (outside + 1)))
    clear = counts.join(whole, "slot").select("domain", "slot", F.log(p / q).alias("odds"), z.alias("z")).filter((F.col("z") > MIN_Z) & (F.col("odds") > MIN_ODDS))
    odds: dict[str, dict[int, float]] = {d: {} for d in domains}
    for r in clear.collect():  # at most SLOTS a domain
        odds[r["domain"]][r["slot"]] = r["odds"]
    return {"domains": domains, "priors": [math.log(sizes[d] / total) for d in domains], "odds": [odds[d] for d in domains]}


def _constant(values, kind: str) -> Column:
    """An array of numbers as one constant, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def posteriors(found: Column, model: dict) -> Column:
    """array<double> over the model's domains, from a text's slots."""
    telling, k = sorted({t for odds in model["odds"] for t in odds}), len(model["domains"])
    index = [-1] * SLOTS
    for place, t in enumerate(telling):
        index[t] = place
    weights = [float(odds.get(t, 0.0)) for t in telling for odds in model["odds"]] or [0.0]
    constants = F.struct(_constant(index, "int").alias("index"), _constant(weights, "double").alias("weights"), _constant(map(float, model["priors"]), "double").alias("priors"))

    def places(m: Column) -> Column:
        """Places of the text's slots that tell."""
        return F.transform(F.filter(found, lambda s: F.get(m["index"], s) >= 0), lambda s: F.get(m["index"], s))

    def logits(hits: Column, m: Column) -> Column:
        temper = F.sqrt(F.greatest(F.size(hits), F.lit(1)).cast("double"))
        return F.transform(m["priors"], lambda prior, d: prior + F.aggregate(hits, F.lit(0.0), lambda total, place: total + F.get(m["weights"], place * k + d)) / temper)

    def soft(x: Column) -> Column:
        return F.transform(x, lambda v: F.exp(v - F.array_max(x)))

    return once(constants, lambda m: once(places(m), lambda h: once(logits(h, m), lambda x: once(soft(x), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))))))


def fit_rates(members: DataFrame, targets: list[float], tolerance: float = TOLERANCE, gain: float = GAIN) -> tuple[Column, dict]:
    """The rate as a column over members (n_tokens, p0, p1, ...: double), and what the fit reached.

    Minimises |totals - targets|^2 over rates >= 0, where totals are sum_i r_i n_i p_i, by projected gradients from r = 1. The steps
    so far add up to one vector y, and the rates are the projection max(0, 1 - p_i . y): the projection comes last, so a
    rate is told by y alone. A pull e * sum n_i (r_i - 1)^2 towards 1 makes the best y unique; it is the maximum of a concave
    function of as many variables as there are domains, whose gradient is totals - targets - e * y, and each step goes up that
    gradient in the metric of its curvature (sums of n_i p_i p_i^T over documents not at zero), shortened until
    the function grows. The pull then shrinks tenfold, until the totals are within tolerance of the targets or
    their squared distance gains less than a share of `gain`, which is where targets are out of reach.
    """
    k, goal = len(targets), np.array(targets, float)
    names = [f"p{d}" for d in range(k)]
    # Rates depend on posteriors only: documents of equal ones are one row.
    rows = staged(members.groupBy(F.array(*names).alias("p")).agg(F.sum("n_tokens").alias("n")).filter("n > 0"), "memberships")
    n = F.col("n")

    def along(p: Column, y: np.ndarray) -> Column:
        return F.aggregate(F.zip_with(p, _constant(map(float, y), "double"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def at(y: np.ndarray, pull: float) -> tuple[float, np.ndarray, np.ndarray]:
        """The function, the totals and the curvature: sums over all rows of an array of 1 + k + k * k numbers, place by place."""
        own = rows.select("p", "n", along(F.col("p"), y).alias("x"))
        x, still = F.col("x"), F.col("x") < 1
        r = F.greatest(F.lit(0.0), 1 - x)
        curves = F.flatten(F.transform("p", lambda a: F.transform("p", lambda b: F.when(still, n * a * b).otherwise(0.0))))
        each = F.concat(F.array(n * F.when(still, x - x * x / 2).otherwise(0.5)), F.transform("p", lambda a: n * r * a), curves)
        found = np.zeros(1 + k + k * k)
        for s in own.select(F.posexplode(each).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
            found[s["i"]] = s["v"]
        return found[0] - y @ goal - pull / 2 * (y @ y), found[1 : 1 + k], found[1 + k :].reshape(k, k)

    y, jobs, squares, scale = np.zeros(k), 0, math.inf, max(float(goal.sum()), 1e-9)
    pull = scale / k / 100
    totals = np.zeros(k)
    while True:
        value, totals, curve = at(y, pull)
        jobs += 1
        while True:
            slope = totals - goal - pull * y
            if np.abs(slope).max() <= tolerance / 10 * scale:
                break
            step = np.linalg.solve(curve + pull * np.eye(k), slope)
            length = 1.0
            while length > 1e-6:
                after = at(y + length * step, pull)
                jobs += 1
                if after[0] >= value + 0.1 * length * (slope @ step):
                    break
                length /= 4
            else:
                break  # as far as numbers of this size tell
            y, (value, totals, curve) = y + length * step, after
        now = float(((totals - goal) ** 2).sum())
        near = np.abs(totals - goal).max() <= tolerance * scale
        if near or now >= squares * (1 - gain) or pull < scale * 1e-12:
            break
        # Out of reach, pull * y tends to the residual: it starts there.
        y, squares, pull = y * (10 if now > 0.5 * squares else 1), now, pull / 10
    rate = F.greatest(F.lit(0.0), 1 - along(F.array(*names), y))
    return rate, {"totals": totals.tolist(), "residual": (totals - goal).tolist(), "reached": bool(near), "jobs": jobs}


def quality_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table (doc_id, quality, toxic): junk, toxic, clean."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


#: Production weights of the domains above; a domain without a weight gets none.
WEIGHTS = {"clean": 0.95, "toxic": 0.03, "junk": 0.02}


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, max_labelled: int = MAX_LABELLED, tokens: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens (words, or the column tokens of docs), posteriors, rate and copies (whole copies to write, rate in expectation) for every row,
    and residual: by domain, expected tokens less their target, alike in all rows.

    The targets share out the tokens there are by weights (WEIGHTS; equal if no domain has one).
    """
    weights = WEIGHTS if weights is None else weights
    model = fit_classifier(docs, labels, max_labelled)
    words = words_of(text_of())
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.xxhash64(text_of()).alias("text_key"), words.alias("words"), (F.lit(None) if tokens is None else F.coalesce(F.col(tokens), F.lit(0))).cast("double").alias("given"))
    n_tokens = (F.size("words").cast("double") if tokens is None else F.col("given")).alias("n_tokens")
    own = own.select("doc_id", "source", "text_key", n_tokens, posteriors(slots(F.col("words")), model).alias("posteriors"))
    members = staged(own, "members")
    members = members.select("*", *[F.get("posteriors", F.lit(d)).alias(f"p{d}") for d in range(len(model["domains"]))])
    total = members.agg(F.sum("n_tokens")).first()[0] or 0.0
    given = np.array([weights.get(d, 0.0) for d in model["domains"]])
    given = given / given.sum() if given.sum() > 0 else np.full(len(given), 1 / len(given))
    rate, fit = fit_rates(members, (total * np.maximum(given, 1e-6)).tolist())
    draw = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    out = members.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + draw).cast("long"))
    return out.select("doc_id", "source", "text_key", F.col("n_tokens").cast("long").alias("n_tokens"), "posteriors", F.array(*map(F.lit, model["domains"])).alias("domains"), "rate", "copies", _constant(fit["residual"], "double").alias("residual"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs with each row written as often as its copies say."""
    other = mixed.filter("copies != 1").select(F.col("doc_id").alias("_m_id"), F.col("text_key").alias("_m_key"), F.col("copies").alias("_m_copies")).distinct()
    both = docs.join(small_side(other), F.col("doc_id").eqNullSafe(F.col("_m_id")) & (F.xxhash64(text_of()) == F.col("_m_key")), "left")
    times = F.coalesce("_m_copies", F.lit(1)).cast("int")
    return both.filter(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
