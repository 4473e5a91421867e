"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Each document becomes a vector of transformed statistics: the log of its mean
word length, and the square roots of its shares of symbols, of repeated lines
and of words in repeated three-word windows.  For every language and source a
minimum-covariance-determinant estimate is made by concentration steps: the
``SHARE`` of documents with the least Mahalanobis distance gives the next mean and
covariance, until the core no longer changes (``STEPS`` at most).  There are two
starts, the medians with the least variances and with those of the quartiles; after
``TRIALS`` steps the one of the smaller determinant goes on.  Documents beyond a
chi-squared quantile of the final distance are rejected, besides those that fail the
base rules.

A step is one pass: rows are reduced to counts and sums for each bin of the distance,
which are mergeable, so a source with a third of all rows is no task of its own, and
the core's moments are running sums over the bins.  The Cholesky factor is
written out as column expressions.  Groups of fewer than ``LEAST`` documents are
pooled by language, and languages with fewer still with each other.

Defined cases: null or empty text has no words and fails the base rules; null
language or source is a group of its own; documents that fail take no part in
the estimates; repeated rows count each; equal statistics have equal distances;
a statistic that hardly varies has the variance floor of its ``FLOORS``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checked, forget, stored

WORDS_RE, BLANK_RE, SYMBOL_RE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Features and the least standard deviation each is taken to have: 6 percent of a word for x0, one unit in about 300 for x1, in 100 for x2 and x3.
FLOORS = {"x0": 0.06, "x1": 0.06, "x2": 0.1, "x3": 0.1}
SHARE, STEPS, TRIALS, LEAST, QUANTILE = 0.75, 30, 2, 40, 0.999
#: Change of the estimates below which the core counts as settled.
SETTLED = 1e-9
#: Histogram bins for a factor e of the squared distance.
BINS = 32


def statistics(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, body.alias("_t"))
    df = df.select(*keep, "_t", F.filter(F.split("_t", WORDS_RE), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(BLANK_RE)).alias("_lines"))
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.char_length(F.array_join("_w", "")),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOL_RE)),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
    }
    windows = F.transform("_w", lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))
    df = df.select(*keep, *(c.cast("long").alias(k) for k, c in counts.items()), F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0)))).alias("_s"))
    same = lambda x, i: F.coalesce(F.get("_s", i)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))).drop("_s")
    # A window covers three words, or those up to the next repeated window.
    cover = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vectors(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``stats`` with features x0.. and the group of each row; stored."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    df = stats.withColumns({
        "x0": F.log(F.greatest(share("word_chars", "n_words"), F.lit(0.5))),
        "x1": F.sqrt(share("n_symbols", "word_chars")),
        "x2": F.sqrt(share("n_dup_lines", "n_lines")),
        "x3": F.sqrt(share("n_repeat_words", "n_words")),
        "_l": F.to_json(F.struct(lang)),
        "_g": F.to_json(F.struct(lang, source)),
        "base_failed": base_failed(),
    })
    sizes = df.groupBy("_l", "_g").agg(F.count_if(~F.col("base_failed")).alias("n"))
    pooled = sizes.withColumn("_pool", F.when(F.col("n") >= LEAST, F.col("_g")))
    rest = sizes.filter(F.col("n") < LEAST).groupBy("_l").agg(F.sum("n").alias("rest"))
    pooled = pooled.join(rest, "_l", "left").select("_g", F.coalesce("_pool", F.when(F.col("rest") >= LEAST, F.col("_l")), F.lit("*")).alias("group"))
    groups = stored(pooled, "groups")
    out = stored(df.join(checked(groups), "_g").drop("_g", "_l"), "quality")
    forget(groups)
    return out


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return hi


def distance(dims: list[str]) -> Column:
    """Squared Mahalanobis distance to the row's mean m_i under the factor l_ij, by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(dims):
        z.append((F.col(x) - F.col(f"m{i}") - reduce(lambda a, j: a + F.col(f"l{i}{j}") * z[j], range(i), F.lit(0.0))) / F.col(f"l{i}{i}"))  # noqa: B023
    return reduce(lambda a, b: a + b, [c * c for c in z])


def factored(moments: DataFrame, dims: list[str]) -> DataFrame:
    """group, start, m_i and the Cholesky factor l_ij of the covariance s_ij, the variances not below their floors."""
    df = moments.withColumns({f"s{i}{i}": F.greatest(F.col(f"s{i}{i}"), F.lit(FLOORS[x] ** 2)) for i, x in enumerate(dims)})
    for i in range(len(dims)):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"s{i}{j}"))  # noqa: B023
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return df.select("group", "start", *(f"m{i}" for i in range(len(dims))), *(f"l{i}{j}" for i in range(len(dims)) for j in range(i + 1)))


def starts(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Two starts for each group: medians with the floors' variances, and with those that the quartiles of a normal sample have."""
    quartiles = rows.groupBy("group").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i, x in enumerate(dims)))
    both = quartiles.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    spread = lambda i: (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349
    variances = {f"s{i}{j}": F.when(F.col("start") == 1, spread(i) * spread(i)).otherwise(0.0) if i == j else F.lit(0.0) for i in range(len(dims)) for j in range(i + 1)}
    return factored(both.select("group", "start", *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(len(dims))), *(c.alias(k) for k, c in variances.items())), dims)


def concentrated(rows: DataFrame, params: DataFrame, dims: list[str], share: float) -> DataFrame:
    """The next estimates: mean and covariance of the nearest ``share`` of each group, to whole bins of the distance."""
    scale = share / chi2_cdf(chi2_quantile(share, len(dims)), len(dims) + 2)
    pairs = [(i, j) for i in range(len(dims)) for j in range(i + 1)]
    near = rows.join(params, "group").withColumn("bin", F.floor(F.log(distance(dims) + 1e-9) * BINS))
    sums = {"n": F.count("*"), **{f"t{i}": F.sum(x) for i, x in enumerate(dims)}, **{f"u{i}{j}": F.sum(F.col(dims[i]) * F.col(dims[j])) for i, j in pairs}}
    bins = near.groupBy("group", "start", "bin").agg(*(c.alias(k) for k, c in sums.items()))
    own = Window.partitionBy("group", "start")
    run = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    so_far = bins.select("group", "start", F.col("n").alias("_n"), F.sum("n").over(own).alias("_all"), *(F.sum(k).over(run).alias(k) for k in sums))
    core = so_far.filter((F.col("n") >= share * F.col("_all")) & (F.col("n") - F.col("_n") < share * F.col("_all")))
    moments = core.select("group", "start", *((F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in range(len(dims))), *((scale * (F.col(f"u{i}{j}") / F.col("n") - F.col(f"t{i}") * F.col(f"t{j}") / F.col("n") / F.col("n"))).alias(f"s{i}{j}") for i, j in pairs))
    return factored(moments, dims)


def robust_estimates(rows: DataFrame, dims: list[str], share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """The estimate of each group: m_i, l_ij.  ``rows`` has group and the features."""
    params = stored(starts(rows, dims), "mcd")
    determinant = reduce(lambda a, i: a * F.col(f"l{i}{i}") * F.col(f"l{i}{i}"), range(len(dims)), F.lit(1.0))
    for n in range(1, steps + 1):
        found = concentrated(rows, checked(params), dims, share)
        if n == TRIALS:
            best = F.row_number().over(Window.partitionBy("group").orderBy(determinant, "start"))
            found = found.withColumn("_n", best).filter("_n = 1").drop("_n")
        old, params = params, stored(found, "mcd")
        names = [c for c in params.columns if c not in ("group", "start")]
        moved = params.join(old.select("group", "start", *(F.col(c).alias(f"_{c}") for c in names)), ["group", "start"]).filter(reduce(lambda a, c: a | (F.abs(F.col(c) - F.col(f"_{c}")) > SETTLED), names, F.lit(False)))
        settled = n > TRIALS and moved.isEmpty()
        forget(old)
        if settled:
            break
    return checked(params).drop("start")


def judged(docs: DataFrame, *, quantile: float = QUANTILE, doc_id: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Statistics, base_failed, the squared distance and kept for every row of ``docs``."""
    dims = list(FLOORS)
    stats = stored(statistics(docs, keep=(doc_id, lang, source), text=text), "statistics")
    rows = vectors(stats, lang, source)
    forget(stats)
    params = robust_estimates(rows.filter("NOT base_failed").select("group", *dims), dims)
    out = rows.join(params, "group", "left").withColumn("distance", distance(dims))
    near = F.coalesce(F.col("distance") <= chi2_quantile(quantile, len(dims)), F.lit(False))
    return out.select(doc_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance", "group")
