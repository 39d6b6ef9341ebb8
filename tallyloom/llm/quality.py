"""Quality rules: base rules on a text's words and lines, and robust multivariate outliers.

The method's verdict is by minimum-covariance-determinant estimates. A text's statistics are
transformed to a vector (``FEATURES``); for each language and source, the location and covariance of the most
concentrated ``SHARE`` of the vectors are found by concentration steps: from two starts, the coordinates'
medians with absolute deviations and the means with covariances, again and again keep the vectors of the least Mahalanobis
distance and estimate anew, until no determinant changes (each step lowers it or leaves it). The start that ends at the least determinant holds. A text is rejected if its distance from the last estimate, scaled so that
the median distance is that of normal vectors, is above ``CUTOFF``, the chi-square quantile.

The estimates are sums, so a group of any size costs a row for each task; the distances' quantiles are read
off a histogram of fixed resolution. A covariance gets ``FLOOR`` added on its diagonal: a
statistic that is the same in most texts has no variance of its own. Groups of fewer than ``LEAST``
texts use the estimates of their language, and a language of fewer accepts all.

Only DataFrame functions are used. Results for odd input: null and empty texts have no word, so all
counts are 0 and the base rules reject them; null lang and source are a group of their own. Texts that the base
rules reject are not part of the estimates. Repeated rows are each returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import Scratch, small

SPACE, SPACES = "[ \\t-\\r]+", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SHARE, STEPS, LEAST, FLOOR = 0.75, 12, 50, 0.01
#: Quantiles of chi-square with as many degrees of freedom as there are features: of 1 - 1.5e-7, and of one half.
CUTOFF, MEDIAN = 37.33, 3.357
#: Distances are counted in steps of this ratio.
RATIO = 1.02
FEATURES = ["f0", "f1", "f2", "f3"]


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    words = F.array_remove(F.split("text", SPACE), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = d.select(
        "doc_id",
        "lang",
        "source",
        words.alias("words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.instr("text", "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("n_words", F.size("words").cast("long"))
    # a window is a 64-bit hash of its words; of the windows that occur twice or more, the positions in order
    # tell how many words they cover: five for the last, and what lies before the next for the others
    windows = F.expr("if(size(words) < 6, cast(array() as array<bigint>), transform(sequence(0, size(words) - 5), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2), get(words, i + 3), get(words, i + 4))))")
    d = d.withColumn("windows", windows)
    # values that are the same as their neighbour's in sorted order occur twice or more
    sorted_ = F.expr("sort_array(transform(windows, (w, i) -> named_struct('w', w, 'i', i)))")
    twice = "filter(sorted, (x, k) -> (k > 0 and get(sorted, k - 1).w = x.w) or (k + 1 < size(sorted) and get(sorted, k + 1).w = x.w))"
    none = F.size(F.array_distinct("windows")) == F.size("windows")
    d = d.withColumn("sorted", F.when(none, F.expr("cast(array() as array<struct<w: bigint, i: int>>)")).otherwise(sorted_))
    d = d.withColumn("at", F.expr(f"sort_array(transform({twice}, x -> x.i))"))
    covered = F.expr("if(size(at) = 0, 0L, 5L + aggregate(sequence(1, size(at)), 0L, (n, k) -> n + if(k < size(at), least(5, get(at, k) - get(at, k - 1)), 0)))")
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _features() -> list[Column]:
    n = F.greatest("n_words", F.lit(1))
    return [
        F.log(n).alias("f0"),
        (4 * F.log(F.greatest("word_chars", F.lit(1)) / n)).alias("f1"),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("f2"),
        F.sqrt(F.col("n_repeat_words") / n).alias("f3"),
    ]


def _factored(estimates: DataFrame) -> DataFrame:
    """grp and e: the means m0.., and the lower Cholesky factor l00, l10, l11, .. of the covariances s00, s01, s11, .."""
    n = len(FEATURES)
    for i in range(n):
        for j in range(i + 1):
            x = F.col(f"s{j}{i}")
            for k in range(j):
                x = x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(F.greatest(x, F.lit(1e-9))) if i == j else x / F.col(f"l{j}{j}"))
    return estimates.select("grp", F.struct(*[f"m{i}" for i in range(n)], *[f"l{i}{j}" for i in range(n) for j in range(i + 1)]).alias("e"))


def _distance() -> Column:
    """The squared Mahalanobis distance from the estimate e: solves with the factor, row by row."""
    solved: list[Column] = []
    for i in range(len(FEATURES)):
        x = F.col(f"f{i}") - F.col(f"e.m{i}")
        for k in range(i):
            x = x - F.col(f"e.l{i}{k}") * solved[k]
        solved.append(x / F.col(f"e.l{i}{i}"))
    return sum((F.pow(x, 2) for x in solved[1:]), F.pow(solved[0], 2))


def _estimate() -> list[Column]:
    """Means and covariances, rounded so that the order of summing is of no consequence."""
    means = [F.round(F.avg(f), 9).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    pairs = [(i, j) for j in range(len(FEATURES)) for i in range(j + 1)]
    return means + [F.round(F.covar_pop(f"f{i}", f"f{j}") + (FLOOR if i == j else 0), 9).alias(f"s{i}{j}") for i, j in pairs]


def _with(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    return rows.join(small(estimates), "grp", "left")


def _cut(rows: DataFrame, by: list[str], step: Column, share: float) -> DataFrame:
    """by and step: the least step of a histogram of fixed resolution up to which the share of rows lies."""
    steps = rows.select(*by, step.alias("step")).groupBy(*by, "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    cum = steps.withColumn("cum", F.sum("n").over(w.orderBy("step"))).withColumn("all", F.sum("n").over(w))
    return cum.where(F.col("cum") >= F.lit(share) * F.col("all")).groupBy(*by).agg(F.min("step").alias("step"))


def _quantile(rows: DataFrame, share: float) -> DataFrame:
    """grp, limit: the upper end of the histogram's step that the share's quantile of d2 is in."""
    step = F.ceil(F.log(F.greatest("d2", F.lit(1e-6))) / F.log(F.lit(RATIO)))
    return _cut(rows, ["grp"], step, share).select("grp", F.pow(F.lit(RATIO), F.col("step")).alias("limit"))


def _medians(rows: DataFrame, prefix: str) -> DataFrame:
    """grp and the median of each of the features, to 1 / 256."""
    long = rows.select("grp", F.posexplode(F.array(*FEATURES)).alias("nth", "f"))
    cut = _cut(long, ["grp", "nth"], F.round(F.col("f") * 256), 0.5)
    return cut.groupBy("grp").agg(*[F.max(F.when(F.col("nth") == i, F.col("step") / 256)).alias(f"{prefix}{i}") for i in range(len(FEATURES))])


def _starts(vectors: DataFrame) -> DataFrame:
    """grp, start and e: medians with absolute deviations (0), and means with covariances (1)."""
    n = range(len(FEATURES))
    middle = _medians(vectors, "m")
    spread = _medians(_with(vectors, middle).select("grp", *[F.abs(F.col(f) - F.col(f"m{i}")).alias(f) for i, f in enumerate(FEATURES)]), "a")
    cov = [(F.pow(1.4826 * F.col(f"a{i}"), 2) + FLOOR if i == j else F.lit(0.0)).alias(f"s{i}{j}") for j in n for i in range(j + 1)]
    robust = _factored(middle.join(spread, "grp").select("grp", *[f"m{i}" for i in n], *cov))
    plain = _factored(vectors.groupBy("grp").agg(*_estimate()))
    return robust.withColumn("start", F.lit(0)).unionByName(plain.withColumn("start", F.lit(1)))


def _concentrated(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """grp and e of the start whose concentration steps end at the least determinant.

    Steps go on until no determinant changes, as each lowers it or leaves it; ``STEPS`` bounds them.
    """
    key = F.concat_ws(":", F.col("start").cast("string"), "grp")
    est = scratch.keep(_starts(vectors).select(key.alias("grp"), "e", F.lit(None).cast("double").alias("det")), "e0")
    both = vectors.withColumn("grp", F.explode(F.array(F.concat(F.lit("0:"), "grp"), F.concat(F.lit("1:"), "grp"))))
    for step in range(1, STEPS + 1):
        near = _with(both, est.drop("det")).withColumn("d2", _distance())
        kept = near.join(small(scratch.keep(_quantile(near, SHARE), f"limit{step}")), "grp").where("d2 <= limit")
        new = _factored(kept.groupBy("grp").agg(*_estimate()))
        det = sum((F.log(F.col(f"e.l{i}{i}")) for i in range(1, len(FEATURES))), F.log(F.col("e.l00")))
        old = est
        est = scratch.keep(new.withColumn("det", F.round(2 * det, 6)), f"e{step}")
        moved = est.join(old.select("grp", F.col("det").alias("before")), "grp").where("before is null or before <> det").limit(1).count()
        scratch.drop(f"limit{step}", f"e{step - 1}")
        if not moved:
            break
    best = est.select(F.substring_index("grp", ":", 1).cast("int").alias("start"), F.expr("substring(grp, instr(grp, ':') + 1)").alias("grp"), "e", "det")
    return best.groupBy("grp").agg(F.min_by("e", F.struct("det", "start")).alias("e"))


def verdicts(documents: DataFrame) -> DataFrame:
    """The statistics, base_failed, distance (squared, null if no estimate holds) and kept of every row."""
    scratch = Scratch(documents.sparkSession, "quality")
    rows = statistics(documents).withColumn("base_failed", base_failed()).select("*", *_features())
    rows = scratch.keep(rows, "rows")
    good = rows.where(~F.col("base_failed"))
    # every vector counts in two groups: its language's, and its language's and source's
    lang, both = F.struct("lang", F.lit(None).cast("string").alias("source"), F.lit(0).alias("level")), F.struct("lang", "source", F.lit(1).alias("level"))

    def keyed(x: Column) -> Column:
        return F.to_json(x, {"ignoreNullFields": "false"})

    vectors = good.select(*FEATURES, F.explode(F.array(keyed(lang), keyed(both))).alias("grp"))
    est = scratch.keep(_concentrated(vectors, scratch), "best")
    near = _with(vectors, est).withColumn("d2", _distance())
    sizes = vectors.groupBy("grp").agg(F.count("*").alias("n"))
    final = scratch.keep(est.join(_quantile(near, 0.5).withColumnRenamed("limit", "median"), "grp").join(sizes, "grp").where(F.col("n") >= LEAST).drop("n"), "final")
    one, two = final.toDF("g1", "e1", "median1"), final.toDF("g2", "e2", "median2")
    out = rows.withColumn("g1", keyed(both)).withColumn("g2", keyed(lang)).join(small(one), "g1", "left").join(small(two), "g2", "left")
    out = out.withColumn("e", F.coalesce("e1", "e2")).withColumn("median", F.when(F.col("e1").isNotNull(), F.col("median1")).otherwise(F.col("median2")))
    # the concentrated part's covariance is too small for the whole; it is never scaled down
    d2 = _distance() * F.least(F.lit(1.0), F.lit(MEDIAN) / F.col("median"))
    out = out.withColumn("distance", F.when(F.col("e").isNotNull() & ~F.col("base_failed"), d2))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"))


def report(documents: DataFrame) -> DataFrame:
    return verdicts(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
