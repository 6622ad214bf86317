"""Mixing documents to target weights of domains, with soft membership.

1. Classifier. Multinomial naive Bayes over the distinct words of a text (those outside the vocabulary count as one kind) and a few marks of its make-up (``#upper``, ``#symbols``,
   ``#repeats``). It is fitted on at most ``max_labelled`` labelled rows (smallest hash of the id); its vocabulary is the ``vocabulary``
   features that tell the domains apart best. Scoring explodes each text's distinct words and joins that bounded vocabulary by
   broadcast; sums combine before the shuffle. The log odds are divided by the fourth root of the number of features seen, which keeps
   posteriors of long texts from saturating.
2. Rates. Nonnegative rates r(d) minimise

       1/2 sum_k w_k (S_k - T_k)^2 + lambda/2 sum_d n_d (r_d - 1)^2 / N,   S_k = sum_d r_d n_d p_dk / N

   with n_d tokens, posteriors p_dk, targets T_k and weights w_k = 1 / (first share of k). Projected gradient: a step lowers each
   rate by its part of the gradient and cuts it at zero. A step's gradient depends on the K numbers S_k only, so
   a document's rate is a function of its posteriors and the list of steps so far: an iteration is one aggregate to a row of
   K sums over one expression, and every ``STEPS_KEPT`` steps the rates are written, which keeps that expression short.

Only DataFrame functions. Defined cases: a null or empty text has no words and the prior as posterior; rows with equal id and text have equal rates and
are returned as often as they came; without labels all domains are equally likely; an empty table gives an empty table; a domain
without any posterior mass cannot meet its target and the rest is fitted as near as it can be; extra columns are ignored by ``fit_rates`` and
stay in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.session import cut_lineage

DOMAINS = ["clean", "toxic", "junk"]
TARGETS = {"clean": 0.97, "toxic": 0.01, "junk": 0.02}
SYMBOLS = "#*$%&|<>!"
ALWAYS, OTHER = "#any", "#other"
STEPS_KEPT = 12


def domain_of_labels(labels: DataFrame, id_col: str = "doc_id", max_labelled: int = 20_000) -> DataFrame:
    """``id, k`` (place in DOMAINS) of at most ``max_labelled`` labelled rows, one per id (of several labels the last in DOMAINS)."""
    k = F.when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).otherwise(0)
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).alias("id"), k.alias("k")).groupBy("id").agg(F.max("k").alias("k")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)


def _count(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` in the class ``chars``: what is left when the runs of all others go."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def features(docs: DataFrame) -> DataFrame:
    """``id, h, n, words`` of rows ``id, text``: hash of the text, number of words, distinct features."""
    raw = F.coalesce("text", F.lit(""))
    d = docs.select("id", F.xxhash64(raw).alias("h"), F.array_remove(F.split(F.lower(raw), r"[\x20\x09-\x0D]+"), "").alias("all"), raw.alias("raw"),
                    _count(raw, "A-Z").alias("capitals"), _count(raw, SYMBOLS).alias("symbols"))
    n = F.size("all").cast("long")
    # where the letter e alone is as frequent as all capitals, these cannot outnumber a-z
    often = F.length("raw") - F.length(F.replace("raw", F.lit("e"), F.lit("")))
    upper = F.when(often >= F.col("capitals"), F.lit(False)).otherwise(F.col("capitals") > _count(F.col("raw"), "a-z"))
    d = d.select("id", "h", n.alias("n"), F.array_distinct("all").alias("words"), upper.alias("upper"), (4 * F.col("symbols") > n).alias("symbols"))
    marks = [F.lit(OTHER), F.when(F.col("upper"), F.lit("#upper")), F.when(F.col("symbols"), F.lit("#symbols")),
             F.when(10 * F.size("words") < 4 * F.col("n"), F.lit("#repeats")), F.lit(ALWAYS)]
    return d.select("id", "h", "n", F.concat("words", F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("words"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, vocabulary: int = 4096) -> DataFrame:
    """``w, lw``: the chosen features with their log weight per domain; ``ALWAYS`` has the log priors and ``OTHER`` the log
    weights of all words outside the vocabulary. At most ``vocabulary`` + 2 rows."""
    n_dom = len(DOMAINS)
    seen = features(docs.join(F.broadcast(labelled), "id").groupBy("id").agg(F.min("text").alias("text")))  # labelled has at most max_labelled rows
    # never empty, so the outer form gives the same rows; the inner one adds a filter that computes the words again
    rows = seen.join(F.broadcast(labelled), "id").select("k", F.explode_outer("words").alias("w"))
    counts = cut_lineage(rows.groupBy("w").agg(*[F.sum((F.col("k") == k).cast("long")).alias(f"c{k}") for k in range(n_dom)]))
    special = F.col("w").isin(ALWAYS, OTHER)
    docs_of = counts.filter(F.col("w") == ALWAYS).first()
    sizes = [int(docs_of[f"c{k}"]) if docs_of else 0 for k in range(n_dom)]
    total = counts.filter(~special).agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(n_dom)]).first()
    words = [int(total[f"c{k}"] or 0) for k in range(n_dom)]
    p = [(F.col(f"c{k}") + 0.5) / (words[k] + 0.5 * vocabulary + 1) for k in range(n_dom)]
    every = sum((F.col(f"c{k}") for k in range(n_dom)), F.lit(0)) / max(1, sum(words))
    gain = sum((F.col(f"c{k}") * F.log(p[k] / (every + 1e-12)) for k in range(n_dom)), F.lit(0.0))
    often = " + ".join(f"c{k}" for k in range(n_dom)) + " >= 3"
    best = cut_lineage(counts.filter(~special).filter(often).orderBy(F.desc(gain), "w").limit(vocabulary))
    inside = best.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(n_dom)]).first()
    rest = [(words[k] - int(inside[f"c{k}"] or 0) + 0.5) / (words[k] + 0.5 * vocabulary + 1) for k in range(n_dom)]
    spark = docs.sparkSession
    one = lambda name, values: spark.range(1).select(F.lit(name).alias("w"), F.array(*[F.log(F.lit(v)) for v in values]).alias("lw"))
    return (best.select("w", F.array(*[F.log(x) for x in p]).alias("lw")).unionByName(one(OTHER, rest))
            .unionByName(one(ALWAYS, [(n + 1.0) / (sum(sizes) + n_dom) for n in sizes])))


def posteriors(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``id, h, rows, n, p``: one row per distinct (id, text) with its multiplicity, tokens and domain posteriors."""
    n_dom = len(DOMAINS)
    always, other = ({r["w"]: r["lw"] for r in vocabulary.filter(F.col("w").isin(ALWAYS, OTHER)).collect()}[w] for w in (ALWAYS, OTHER))  # two rows
    table = vocabulary.filter(F.col("w") != OTHER).select("w", *[F.when(F.col("w") == ALWAYS, 0.0).otherwise(F.col("lw")[k]).alias(f"l{k}") for k in range(n_dom)])
    words = features(docs).select("id", "h", "n", F.size("words").alias("m"), F.explode_outer("words").alias("w"))
    per = words.join(F.broadcast(table), "w").groupBy("id", "h").agg(
        F.sum((F.col("w") == ALWAYS).cast("long")).alias("rows"), F.max("n").alias("n"), F.max("m").alias("m"), F.count(F.lit(1)).alias("met"),
        *[F.sum(f"l{k}").alias(f"s{k}") for k in range(n_dom)])
    # repeated rows add up alike, so sums are divided by their number
    seen = F.col("met") / F.col("rows") - 1
    soft = F.sqrt(F.sqrt(F.greatest(F.lit(1.0), seen)))
    score = [F.lit(float(always[k])) + (F.col(f"s{k}") / F.col("rows") + (F.col("m") - 2 - seen) * F.lit(float(other[k]))) / soft for k in range(n_dom)]
    d = per.select("id", "h", "rows", "n", F.array(*score).alias("s"))
    e = F.transform("s", lambda x: F.exp(x - F.array_max("s")))
    d = d.select("id", "h", "rows", "n", e.alias("e"))
    return d.select("id", "h", "rows", "n", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def _rate(start: Column, steps: list[list[float]], shrink: float, pull: float) -> Column:
    """Rate after the given steps: r <- max(0, shrink * r + pull - p . g)."""
    r = start
    for g in steps:
        r = F.greatest(F.lit(0.0), F.lit(shrink) * r + F.lit(pull) - sum((F.col(f"p{k}") * F.lit(float(x)) for k, x in enumerate(g)), F.lit(0.0)))
    return r


def fit_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
              ridge: float = 0.002, step: float = 1.0, rounds: int = 60, tolerance: float = 2e-3, max_labelled: int = 20_000,
              vocabulary: int = 4096) -> DataFrame:
    """``id, h, rows, n, p, rate`` per distinct (id, text) of ``docs`` (h: xxhash64 of the text).

    Stops when all domain shares are within ``tolerance`` of their targets, when a step changes nothing any more, or after ``rounds``.
    """
    want = [float((targets or TARGETS)[d]) for d in DOMAINS]
    want = [w / sum(want) for w in want]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = cut_lineage(domain_of_labels(labels, id_col, max_labelled))
    d = posteriors(texts, cut_lineage(fit_classifier(texts, known, vocabulary)))
    d = cut_lineage(d.select("*", *[F.col("p")[k].alias(f"p{k}") for k in range(len(want))], F.lit(1.0).alias("r")))
    weight = F.col("n") * F.col("rows")
    shares = lambda rate: d.agg(F.sum(weight).alias("N"), *[F.sum(weight * rate * F.col(f"p{k}")).alias(f"s{k}") for k in range(len(want))]).first()
    start = shares(F.col("r"))
    total = float(start["N"] or 0)
    steps: list[list[float]] = []  # since the rates were last written
    shrink, pull = 1 - step * ridge, step * ridge
    if total:
        first = [max(float(start[f"s{k}"]) / total, 1e-6) for k in range(len(want))]
        now, before = start, None
        for _ in range(rounds):
            s = [float(now[f"s{k}"]) / total for k in range(len(want))]
            if max(abs(a - b) for a, b in zip(s, want)) < tolerance or (before and max(abs(a - b) for a, b in zip(s, before)) < 1e-5):
                break
            if len(steps) == STEPS_KEPT:
                d, steps = cut_lineage(d.withColumn("r", _rate(F.col("r"), steps, shrink, pull))), []
            steps.append([step * (s[k] - want[k]) / first[k] for k in range(len(want))])
            before, now = s, shares(_rate(F.col("r"), steps, shrink, pull))
    return d.select("id", "h", "rows", "n", "p", _rate(F.col("r"), steps, shrink, pull).alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with each row repeated by its rate: the whole part always, the rest with its own probability, drawn from a hash of id and text.
    All columns stay."""
    r = fit_rates(docs, labels, targets, id_col, text_col, **params).select(
        F.col("id").alias("__id"), F.col("h").alias("__hash"), F.col("rate").alias("__rate"))
    d = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    j = d.join(r, d[id_col].eqNullSafe(r["__id"]) & (d["__h"] == r["__hash"]), "left")
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col), F.col("__h")), F.lit(1 << 20)) / float(1 << 20)
    copies = (F.floor("__rate") + (draw < F.col("__rate") - F.floor("__rate")).cast("int")).cast("int")
    return j.withColumn("__c", F.explode(F.array_repeat(F.lit(1), F.coalesce(copies, F.lit(1))))).select(*docs.columns)
