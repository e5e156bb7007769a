"""Quality rules: word statistics of a text, and robust multivariate outliers among them.

All of it is DataFrame functions. ``text_statistics`` adds the counts to each row; ``quality_rules`` estimates centre and scatter of
transformed statistics for each language and source by the minimum covariance determinant, and rejects rows whose Mahalanobis distance
is too large.

An estimate has two starts, medians with median deviations (read from histograms) and the plain mean and covariance. Concentration
steps follow from each: the share SUPPORT of rows with the least distances gives the next centre and scatter, until the same rows are
kept again, or MAX_STEPS; the start that ends with the smaller determinant is taken. Each step sums moments by group and distance bin, so
it is one scan of narrow rows with partial sums; no row is moved to its group. Bins are a sixteenth of a natural logarithm wide, and a
step keeps whole bins, so ties and repeated rows stay together.

Languages as a whole are estimated likewise. A group of n rows counts with n / (n + PRIOR_ROWS), its language with the rest, at any
size: few rows don't fix five centres and fifteen covariances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, materialize, scratch, text_of

SUPPORT = 0.75  # share of rows that a concentration step keeps
MAX_STEPS = 10
CONSISTENCY = 1.412  # of the scatter of the nearest three quarters, for normal data in five dimensions: 0.75 / F7(F5^-1(0.75))
PRIOR_ROWS = 50  # ten rows a statistic
CUTOFF = 30.86  # on the squared distance: the 0.99999 quantile of chi-squared with five degrees of freedom
MEDIAN = 4.351  # of it
#: Least deviation of each transformed statistic, so that a scatter of shares that are mostly zero stays regular. That of the repeated
#: shares lets about 0.28, after smoothing, pass where nothing repeats elsewhere.
FLOOR = (0.06, 0.03, 0.03, 0.095, 0.095)
P = 5

WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the counts of punctuation, capitals and lines.

    A null or empty text has no word and all counts 0. Texts of any length are read whole."""
    t = text_of(df, text)
    words = F.array_remove(F.split(t, WORD_GAP, -1), "")
    n = F.size("__w")
    out = df.withColumn("__t", t).withColumn("__w", words)
    three = F.when(n >= 3, F.arrays_zip(F.slice("__w", F.lit(1), n - 2), F.slice("__w", F.lit(2), n - 2), F.slice("__w", F.lit(3), n - 2)))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD))

    def covered(keys):
        """Words within a window whose key occurs twice: positions of such windows, sorted, each covering up to three words."""
        pairs = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(at, lambda a: F.aggregate(F.zip_with(a, F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))))

    def repeated(keys):
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0)))

    return out.select(
        *[out[c] for c in df.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punct", "n_upper", "n_lines")],
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated(F.transform(three, lambda x: F.xxhash64(x))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("__t", F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("n_punct"),
        F.regexp_count("__t", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.size(F.split("__t", "\n", -1)).cast("long").alias("n_lines"),
    )


BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"

#: Transformed statistics: of word length, and of the shares of punctuation, capitals, repeated words and repeated lines. The repeated
#: ones are smoothed by 50 words and 5 lines: two repeated words of a short text say little.
VECTOR = (
    "ln(1e0 + word_chars / (n_words * 1e0))",
    "sqrt(n_punct / (word_chars * 1e0))",
    "sqrt(n_upper / (word_chars * 1e0))",
    "sqrt(n_repeat_words / (n_words + 50e0))",
    "sqrt(n_dup_lines / (n_lines + 5e0))",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punct", "n_upper", "n_lines")
ONES = range(1, P + 1)
PAIRS = [(i, j) for i in ONES for j in range(1, i + 1)]


def _small(groups: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(groups) if few else groups


def _precision(state: DataFrame) -> DataFrame:
    """Adds the factor wij with distance |w (x - m)|^2, the inverse of the Cholesky factor of scatter and floors, and its determinant, det."""
    cols = []
    for i, j in PAIRS:
        less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        cols.append(f"sqrt(c{i}{i} + {FLOOR[i - 1] ** 2!r}D{less}) AS l{i}{i}" if i == j else f"(c{i}{j}{less}) / l{j}{j} AS l{i}{j}")
    for i, j in PAIRS:
        less = "".join(f" - l{i}{k} * w{k}{j}" for k in range(j, i))
        cols.append(f"({'1D' if i == j else '0D'}{less}) / l{i}{i} AS w{i}{j}")
    cols.append("pow(" + " * ".join(f"l{i}{i}" for i in ONES) + ", 2) AS det")
    return state.selectExpr("*", *cols).drop(*[f"l{i}{j}" for i, j in PAIRS])


def _distance(prefix: str = "") -> Column:
    y = [" + ".join(f"{prefix}w{i}{k} * (x{k} - {prefix}m{k})" for k in range(1, i + 1)) for i in ONES]
    return F.expr(" + ".join(f"pow({x}, 2)" for x in y))


def _bin() -> Column:
    return F.floor(16.0 * F.log(F.col("d2") + 1e-6)).alias("b")


def _medians(rows: DataFrame) -> DataFrame:
    """Medians of x1..x5 of each group, to half a 256th."""
    long = rows.select("g", F.posexplode(F.array(*[f"x{i}" for i in ONES])).alias("c", "x"))
    cells = long.groupBy("g", "c", F.floor(F.col("x") * 256.0).alias("b")).agg(F.count("*").alias("n"))
    over = Window.partitionBy("g", "c")
    cells = cells.withColumn("upto", F.sum("n").over(over.orderBy("b"))).withColumn("all", F.sum("n").over(over))
    middle = cells.filter((2 * F.col("upto") >= F.col("all")) & (2 * (F.col("upto") - F.col("n")) < F.col("all")))
    return middle.groupBy("g").agg(*[F.max(F.when(F.col("c") == i - 1, (F.col("b") + 0.5) / 256.0)).alias(f"m{i}") for i in ONES])


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.expr(f"sum(x{i}) AS t{i}") for i in ONES], *[F.expr(f"sum(x{i} * x{j}) AS t{i}{j}") for i, j in PAIRS]]


def _state() -> list[Column]:
    """Centre and scatter of summed moments."""
    return [*[F.expr(f"t{i} / n AS m{i}") for i in ONES], *[F.expr(f"t{i}{j} / n - (t{i} / n) * (t{j} / n) AS c{i}{j}") for i, j in PAIRS]]


def mcd_estimates(rows: DataFrame, few: bool) -> DataFrame:
    """One row for each group g of ``rows`` (g, x1..x5): its rows, centre m1.., scatter cij with the factor for consistency, and the scale
    that brings the median of its distances down to that of chi-squared, 1 at least. ``few`` says that groups are few enough to broadcast.

    Tables between steps have a row for each group and start, so a lost executor repeats one step."""
    middle = materialize(_medians(rows), "medians")
    apart = rows.join(_small(middle, few), "g").select("g", *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}") for i in ONES])
    spread = _medians(apart).select("g", *[F.col(f"m{i}").alias(f"s{i}") for i in ONES])
    robust = middle.join(spread, "g").select("g", F.lit(0).alias("start"), *[f"m{i}" for i in ONES], *[(F.pow(F.col(f"s{i}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    plain = rows.groupBy("g").agg(*_moments()).select("g", F.lit(1).alias("start"), *_state())
    state = materialize(_precision(robust.unionByName(plain)).withColumn("kept", F.lit(-1).cast("long")), "step")
    keys = ["g", "start"]
    for _ in range(MAX_STEPS):
        bins = rows.join(_small(state.select(*keys, *[f"m{i}" for i in ONES], *[f"w{i}{j}" for i, j in PAIRS]), few), "g").withColumn("d2", _distance())
        bins = bins.groupBy(*keys, _bin()).agg(*_moments())
        over = Window.partitionBy(*keys)
        sums = ["n", *[f"t{i}" for i in ONES], *[f"t{i}{j}" for i, j in PAIRS]]
        upto = bins.select(*keys, F.col("n").alias("own"), F.sum("n").over(over).alias("all"), *[F.expr(f"sum({c}) OVER (PARTITION BY g, start ORDER BY b) AS {c}") for c in sums])
        inner = upto.filter((F.col("n") >= SUPPORT * F.col("all")) & (F.col("n") - F.col("own") < SUPPORT * F.col("all")))
        new = materialize(_precision(inner.select(*keys, F.col("n").alias("kept"), *_state())), "step")
        old = state.select(*keys, F.col("kept").alias("kept_"), F.col("det").alias("det_"))
        state = new
        if new.join(old, keys).filter((F.col("kept") != F.col("kept_")) | (F.abs(F.col("det") - F.col("det_")) > 1e-9 * F.col("det"))).limit(1).count() == 0:
            break
    best = state.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("det", "start"))).filter("rank = 1")
    best = best.select("g", *[f"m{i}" for i in ONES], *[(F.col(f"c{i}{j}") * CONSISTENCY).alias(f"c{i}{j}") for i, j in PAIRS])
    best = materialize(_precision(best), "best")
    bins = rows.join(_small(best, few), "g").withColumn("d2", _distance()).groupBy("g", _bin()).agg(F.count("*").alias("n"))
    over = Window.partitionBy("g")
    bins = bins.withColumn("upto", F.sum("n").over(over.orderBy("b"))).withColumn("n_rows", F.sum("n").over(over))
    scale = bins.filter((2 * F.col("upto") >= F.col("n_rows")) & (2 * (F.col("upto") - F.col("n")) < F.col("n_rows"))).select("g", "n_rows", F.greatest(F.lit(1.0), F.exp((F.col("b") + 1) / 16.0) / MEDIAN).alias("scale"))
    return best.drop("det", *[f"w{i}{j}" for i, j in PAIRS]).join(scale, "g")


def _estimates(stats: DataFrame) -> tuple[DataFrame, bool]:
    """Rows (lang_, source_, m1.., w11.., scale): each group's estimate, drawn to that of its language; and whether they are few."""
    vectors = stats.filter("NOT base_failed").select("lang_", "source_", *[F.expr(x).alias(f"x{i}") for i, x in enumerate(VECTOR, 1)])
    groups = materialize(vectors.select("lang_", "source_").distinct(), "groups")
    few = groups.count() <= BROADCAST_ROWS // 2
    language = F.concat(F.lit("L:"), "lang_")
    own = F.concat(F.char_length("lang_").cast("string"), F.lit(":"), "lang_", "source_")  # no two groups have one name
    rows = vectors.select(F.explode(F.array(language, own)).alias("g"), *[f"x{i}" for i in ONES])
    found = materialize(mcd_estimates(rows, few), "estimates")
    wide = found.select(F.col("g").alias("g_"), *[F.col(c).alias(f"{c}_") for c in found.columns if c not in ("g", "n_rows")])
    both = groups.select("lang_", "source_", own.alias("g"), language.alias("g_")).join(found, "g").join(wide, "g_")
    w = F.col("n_rows") / (F.col("n_rows") + F.lit(float(PRIOR_ROWS)))
    blend = lambda c: w * F.col(c) + (1 - w) * F.col(f"{c}_")
    apart = [F.col(f"m{i}") - F.col(f"m{i}_") for i in ONES]
    scale = F.exp(w * F.log("scale") + (1 - w) * F.log("scale_")).alias("scale")
    drawn = both.select("lang_", "source_", *[blend(f"m{i}").alias(f"m{i}") for i in ONES], *[(blend(f"c{i}{j}") + w * (1 - w) * apart[i - 1] * apart[j - 1]).alias(f"c{i}{j}") for i, j in PAIRS], scale)
    return materialize(_precision(drawn).drop("det"), "drawn", keep=True), few


def quality_rules(df: DataFrame, text: str = "text", *, drop_text: bool = False) -> DataFrame:
    """``df`` with the statistics, base_failed, distance and kept; without the text if ``drop_text``.

    A row that fails the base rules is not kept and has no distance; any other is kept unless its squared distance is above CUTOFF. Null
    languages and sources count as empty ones, and so do missing columns. Rows are never compared by key: repeated rows, null ids and
    ties all get their own verdict. Columns of the same names in ``df`` are replaced, others stay. Empty tables give empty results.
    Statistics are counted once and written, with the columns of the result, to the shared folder."""
    stats = text_statistics(df.drop("base_failed", "distance", "kept"), text)
    stats = stats.drop(text) if drop_text else stats
    shown = stats.columns
    name = lambda c: F.coalesce(df[c].cast("string"), F.lit("")) if c in df.columns else F.lit("")
    stats = materialize(stats.select(*[F.col(c).alias(f"v_{c}") for c in shown], name("lang").alias("lang_"), name("source").alias("source_"), *[F.col(c) for c in COUNTS], F.expr(BASE_FAILED).alias("base_failed")), "stats", keep=True)
    with scratch():
        known, few = _estimates(stats)
    known = known.select(F.col("lang_"), F.col("source_"), *[F.col(c).alias(f"k_{c}") for c in known.columns if c not in ("lang_", "source_")])
    for i, x in enumerate(VECTOR, 1):
        stats = stats.withColumn(f"x{i}", F.when(~F.col("base_failed"), F.expr(x)))
    out = stats.join(_small(known, few), ["lang_", "source_"], "left")
    distance = F.when(~F.col("base_failed"), _distance("k_") / F.col("k_scale"))
    out = out.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF))
    return out.select(*[F.col(f"v_{c}").alias(c) for c in shown], "base_failed", "distance", "kept")
