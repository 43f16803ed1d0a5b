"""Quality rules: base rules, then robust multivariate outliers for each language and source.

Statistics of every whole text are turned into a vector (logs and ratios). For each
group of documents the minimum-covariance-determinant estimate of centre and scatter is sought as is usual: from
several starts (the coordinate-wise median and median deviation, and a few vectors picked by a seeded hash), concentration
steps, in which the half of the vectors nearest by Mahalanobis distance gives the next mean and covariance, lower the
determinant; after two steps the best starts go on until none falls, and the least determinant wins. The vectors within the
0.975 quantile of that estimate then give the final one. A vector counts once in a group,
however many documents have it, so that copies have no weight of their own. A document whose distance from its group's
estimate exceeds the cut is rejected. All steps are aggregations that are combined before they are shuffled, and joins with a few rows a
group, which are sent to every task, so no group meets in one task; the 5 x 5 algebra is column arithmetic.

A group of fewer than MIN_GROUP vectors, too few for an estimate in five dimensions, is judged by
its language's estimate, then by that of all documents. Variances are raised to a floor where they are below it, so that a
statistic that is constant in the nearer half (such as symbols: none) does not make
the scatter singular, nor a document with one symbol an outlier.

Defined results: a null text has no words and fails the base rules, as does an empty
one; null languages and sources are groups of their own; rows that repeat are judged
each, and count once in the estimate; an empty table gives an empty result; further columns of the
input are left out of ``statistics`` and pass through ``apply_rules``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import SPACE, fresh, written, written_measured

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda a plain expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def window_hashes(words: Column) -> Column:
    """A hash of every WINDOW-word window in text order; null if there is at most one."""
    n = F.size(words)
    return F.when(n > WINDOW, bound(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hs: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hs, i, WINDOW))),
    ))


def covered(windows: Column) -> Column:
    """Length of the union of all windows whose hash occurs twice or more; ``windows`` is in text order."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(r: Column) -> Column:
        twice = F.filter(
            r, lambda x, j: (F.get(r, j - 1)["h"] == x["h"]) | (F.get(r, j + 1)["h"] == x["h"])
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    return bound(bound(ranked, places), total)


def statistics(docs: DataFrame, text: str = "text", out: tuple[str, ...] = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) -> DataFrame:
    """``docs`` with the five counts of every whole text."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = out
    words_c, wins_c, lines_c = fresh([*docs.columns, *out], "words", "wins", "lines")
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumns({
            words_c: F.array_remove(F.split(t, SPACE), ""),
            lines_c: F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0),
            n_symbols: (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            word_chars: F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        })
        .withColumn(wins_c, window_hashes(F.col(words_c)))
        .withColumns({
            n_words: F.size(words_c).cast("long"),
            n_dup_lines: (F.size(lines_c) - F.size(F.array_distinct(lines_c))).cast("long"),
            n_repeat: F.when(F.col(wins_c).isNull() | (F.size(F.array_distinct(wins_c)) == F.size(wins_c)), 0)
            .otherwise(covered(F.col(wins_c))).cast("long"),
        })
        .drop(words_c, wins_c, lines_c)
    )


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


#: Transformed statistics and, for each, the least standard deviation an estimate may have. With CUT, a statistic that is
#: off by 5.56 of these rejects alone; base rules leave x4 up to log(4), so its floor has to be below 0.2495.
FLOORS = {"x0": 0.6, "x1": 0.08, "x2": 0.15, "x3": 0.15, "x4": 0.24}


def vectors(n_words: Column, word_chars: Column, n_symbols: Column, n_dup_lines: Column, n_repeat: Column) -> dict[str, Column]:
    """Length, word length, and symbols, repeated lines and repeated words in proportion to length, on log scales."""
    n = F.greatest(n_words, F.lit(1)).cast("double")
    return {
        "x0": F.log1p(n),
        "x1": F.log(F.greatest(word_chars, F.lit(1)) / n),
        "x2": F.log1p(20 * n_symbols / n),
        "x3": F.log1p(50 * n_dup_lines / n),
        "x4": F.log1p(10 * n_repeat / n),
    }


DIMS = list(FLOORS)
PAIRS = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
CENTRE, FACTOR = [f"m_{a}" for a in DIMS], [f"l_{a}_{b}" for a, b in PAIRS]
#: Vectors are kept as whole numbers of this fraction, far below any floor: sums of them are exact in any order, so that a
#: task that runs again, or another number of partitions, gives the same estimate.
GRID = 1024
#: Groups whose estimates are sent to every task; beyond that they are joined, with groups split in PARTS.
MAX_SENT, PARTS = 10_000, 64


def gridded(x: Column) -> Column:
    return F.round(x * GRID).cast("int")


def _with_estimates(points: DataFrame, est: DataFrame, sent: bool) -> DataFrame:
    """Each point with each row of its group in ``est``, without bringing a group together in one task."""
    if sent:
        return points.join(F.broadcast(est), "g")
    parts = est.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return points.withColumn("part", F.pmod(F.xxhash64(*DIMS), F.lit(PARTS)).cast("int")).join(parts, ["g", "part"]).drop("part")


# The algebra is written as SQL text in one projection each, whose later columns use the earlier ones.


def _scatter(points: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products of each key's vectors."""
    sums = ["count(*) AS m", *[f"sum(cast({a} AS double)) AS s_{a}" for a in DIMS], *[f"sum(cast({a} AS double) * {b}) AS s_{a}_{b}" for a, b in PAIRS]]
    return points.groupBy(*keys).agg(*map(F.expr, sums))


def _factored(sums: DataFrame, keep: list[str], scale: str = "1.0D") -> DataFrame:
    """Means and the Cholesky factor of the covariance times ``scale``, as columns m_* and l_*.

    What is left of a variance after the dimensions before it is at least its floor's square, so that vectors that nearly lie in a plane have no small determinant by it.
    """
    cols = [f"s_{a} / m / {GRID} AS m_{a}" for a in DIMS]
    cols += [f"(s_{a}_{b} - s_{a} * s_{b} / m) / m / {GRID**2} * {scale} AS c_{a}_{b}" for a, b in PAIRS]
    for i, a in enumerate(DIMS):
        for j, b in enumerate(DIMS[: i + 1]):
            rest = "".join(f" - l_{a}_{k} * l_{b}_{k}" for k in DIMS[:j])
            square = FLOORS[a] ** 2
            cols.append(f"sqrt(greatest(c_{a}_{a}{rest}, {square}D)) AS l_{a}_{a}" if i == j else f"(c_{a}_{b}{rest}) / l_{b}_{b} AS l_{a}_{b}")
    return sums.selectExpr(*keep, *cols).select(*keep, *CENTRE, *FACTOR)


def _distance(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and d, the squared Mahalanobis distance, by forward substitution."""
    ys = [f"({a} / {GRID} - m_{a}" + "".join(f" - l_{a}_{k} * y_{k}" for k in DIMS[:i]) + f") / l_{a}_{a} AS y_{a}" for i, a in enumerate(DIMS)]
    return df.selectExpr(*keep, *ys, " + ".join(f"y_{a} * y_{a}" for a in DIMS) + " AS d").select(*keep, "d")


def _middle(values: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The least value that half of a key's rows do not exceed, by counting equal values; ``value``, an int, has few different ones.

    Counts are combined before the one shuffle, so the driver has one stage to plan and no window.
    """
    return values.groupBy(*keys).agg(F.expr(f"cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY {value}) AS int) AS {out}"))


#: The half of normal data in five dimensions nearest to its centre, and what lies within its 0.975 quantile, understate the covariance by these factors.
HALF, MOST = 1.912, 1.0555
#: 0.975 quantile of chi-square with five degrees.
WITHIN = 12.8325
#: Fall of the log determinant that counts as one.
FALL = 1e-6
#: Starts from random vectors, besides that from medians; vectors in each, about; steps before the best few go on.
STARTS, FIRST, EARLY, BEST = 4, 8, 2, 2


def _starts(points: DataFrame, sizes: DataFrame, sent: bool) -> DataFrame:
    """(g, s, n, centre, factor): for each group the median and median deviation (s = 0), and estimates of a few vectors picked by a seeded hash."""
    long = points.select("g", F.posexplode(F.array(*DIMS)).alias("a", "x"))
    centre = written(_middle(long, ["g", "a"], "x", "centre"), "medians")
    off = long.join(F.broadcast(centre) if sent else centre, ["g", "a"]).withColumn("off", F.abs(F.col("x") - F.col("centre")))
    spread = _middle(off, ["g", "a"], "off", "spread").join(centre, ["g", "a"])
    of = lambda c, k: f"max(CASE WHEN a = {k} THEN {c} END) / {GRID}"
    wide = [f"{of('centre', k)} AS m_{a}" for k, a in enumerate(DIMS)]
    wide += [f"greatest(1.4826D * {of('spread', k)}, {FLOORS[a]}D) AS l_{a}_{a}" for k, a in enumerate(DIMS)]
    plain = spread.groupBy("g").agg(*map(F.expr, wide), *[F.lit(0.0).alias(f"l_{a}_{b}") for a, b in PAIRS if a != b]).withColumn("s", F.lit(0)).join(sizes, "g")
    picked = _with_estimates(points, sizes, sent).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(STARTS))))
    picked = picked.where(F.pmod(F.xxhash64("s", "g", *DIMS), F.col("n")) < FIRST)
    names = ["g", "s", "n", *CENTRE, *FACTOR]
    random = _factored(_scatter(picked, ["g", "s", "n"]), ["g", "s", "n"])
    return plain.select(*names).unionByName(random.select(*names)).withColumns({"det": F.lit(float("inf")), "falls": F.lit(True)})


def _step(points: DataFrame, est: DataFrame, sent: bool) -> DataFrame:
    """One concentration step of each estimate that still falls: the scatter of the half of its group nearest to it."""
    moving = est.where("falls").select("g", "s", "n", *CENTRE, *FACTOR)
    placed = _distance(_with_estimates(points, moving, sent), ["g", "s", "n", *DIMS])
    placed = placed.selectExpr("g", "s", "n", *DIMS, "cast(floor(log1p(d) * 512) AS int) AS bin")
    cut = _middle(placed, ["g", "s"], "bin", "cut")
    near = placed.join(F.broadcast(cut) if sent else cut, ["g", "s"]).where("bin <= cut")
    names = [*CENTRE, *FACTOR, "det"]
    log_det = " + ".join(f"2 * ln(l_{a}_{a})" for a in DIMS)
    new = _factored(_scatter(near, ["g", "s", "n"]), ["g", "s", "n"], f"{HALF}D").selectExpr("*", f"{log_det} AS det")
    new = new.select("g", "s", F.struct(*names).alias("new"))
    both = est.join(F.broadcast(new) if sent else new, ["g", "s"], "left").withColumnRenamed("falls", "fell").withColumn("falls", F.expr(f"coalesce(new.det < det - {FALL}D, false)"))
    return both.selectExpr("g", "s", "n", *[f"CASE WHEN falls THEN new.{c} ELSE {c} END AS {c}" for c in names], "falls")


def robust(points: DataFrame) -> DataFrame:
    """One row a group ``g``: n, centre (m_*) and factor (l_*) of the half of its vectors whose scatter has the least determinant, reweighted.

    ``points`` has different vectors in grid units in each group, and is read several times, so it should be a written table.
    """
    sizes, of = written_measured(points.groupBy("g").agg(F.count("*").alias("n")), "sizes", groups=F.count("*"))
    sent = of["groups"] <= MAX_SENT
    moving = {"falls": F.count_if("falls")}
    (est, left), k = written_measured(_starts(points, sizes, sent), "mcd", **moving), 0
    while left["falls"]:
        est, k = _step(points, est, sent), k + 1
        if k == EARLY:
            best = F.row_number().over(Window.partitionBy("g").orderBy("det", "s"))  # a row a start
            est = est.withColumn("rank", best).where(F.col("rank") <= BEST).drop("rank")
        est, left = written_measured(est, "mcd", **moving)
    names = ["n", *CENTRE, *FACTOR]
    least = est.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("det", "s")).alias("e")).select("g", "e.*")
    near = _distance(_with_estimates(points, least, sent), ["g", "n", *DIMS]).where(F.col("d") <= WITHIN)
    # the last factor makes the mean squared distance of further documents the number of dimensions for small groups too
    small = f"{MOST}D * (m + 1) / greatest(m - {len(DIMS) + 2}, 1)"
    return written(_factored(_scatter(near, ["g", "n"]), ["g", "n"], small), "mcd")


#: 0.99999 quantile of chi-square with five degrees.
CUT = 30.86


#: Distinct vectors that an estimate needs: six a dimension, with the floors as regularisation.
MIN_GROUP = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", out: tuple[str, ...] = COUNTS,
    cut: float = CUT, kept: str = "kept", failed: str = "base_failed", **how,
) -> DataFrame:
    """``docs`` with the five counts, ``failed`` by the base rules, and the verdict ``kept``.

    Texts are counted once and written with their counts; estimates are made from the counts of all documents that
    pass the base rules. For ``how`` see estimates.
    """
    counted = written(statistics(docs, text, out), "counts")
    return judge(counted, estimates(counted, lang, source, out=out, **how), lang, source, cut, kept, failed, out)


def _group_keys(lang: str, source: str) -> tuple[Column, Column]:
    """Keys of a document's language and source, and of its language; bars inside names are doubled, so that no two pairs share a key."""
    name = lambda x: F.coalesce(F.concat(F.lit("="), F.replace(F.col(x).cast("string"), F.lit("|"), F.lit("||"))), F.lit("null"))
    return F.concat(F.lit("both|"), name(lang), F.lit("|"), name(source)), F.concat(F.lit("lang|"), name(lang))


def estimates(
    counted: DataFrame, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP,
    out: tuple[str, ...] = COUNTS,
) -> DataFrame:
    """(group, e), one row a language and source: the estimate of the narrowest group around it of ``min_group`` vectors.

    ``counted`` has the counts ``out`` and is read several times, so it should be a written table.
    """
    c = [F.col(x) for x in out]
    own, by_lang = _group_keys(lang, source)
    passed = counted.where(~base_failed(c[0], c[4])).select(own.alias("g"), by_lang.alias("l"), *[gridded(v).alias(k) for k, v in vectors(*c).items()])
    vecs = written(passed.distinct(), "vectors")
    sizes = written(vecs.groupBy("g", "l").agg(F.count("*").alias("n")), "groups").withColumn("few", F.col("n") < min_group)
    # a wider group is estimated only where a narrower one is too small
    parts = [vecs.join(sizes.where("not few").select("g"), "g", "left_semi").drop("l")]
    few_langs = written(sizes.where("few").select("l").distinct(), "languages")
    in_few = written(vecs.join(few_langs, "l", "left_semi").select(F.col("l").alias("g"), *DIMS).distinct(), "vectors")
    lang_sizes, of = written_measured(in_few.groupBy("g").agg(F.count("*").alias("n")), "groups", few=F.count_if(F.col("n") < min_group))
    parts.append(in_few.join(lang_sizes.where(F.col("n") >= min_group).select("g"), "g", "left_semi"))
    if of["few"]:
        parts.append(vecs.select(F.lit("all").alias("g"), *DIMS).distinct())
    est = robust(written(reduce(DataFrame.unionByName, parts), "points")).select("g", F.struct(*CENTRE, *FACTOR).alias("e"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), g.alias("g")) for k, g in enumerate((F.col("g"), F.col("l"), F.lit("all")))])
    found = sizes.select(F.col("g").alias("group"), F.explode(levels).alias("at")).select("group", "at.*").join(est, "g")
    return written(found.groupBy("group").agg(F.min_by("e", "level").alias("e")), "estimates")


def judge(
    counted: DataFrame, own: DataFrame, lang: str = "lang", source: str = "source", cut: float = CUT, kept: str = "kept",
    failed: str = "base_failed", out: tuple[str, ...] = COUNTS,
) -> DataFrame:
    """The verdicts for a table that has the counts ``out``, by the ``estimates`` own."""
    c = [F.col(x) for x in out]
    bad, vec = base_failed(c[0], c[4]), vectors(*c)
    key, group, v, d = fresh([*counted.columns, kept, failed], "own_key", "own_group", "v", "d")
    own = own.select(F.col("group").alias(group), F.col("e").alias(v))
    own = F.broadcast(own) if own.count() <= MAX_SENT else own
    joined = counted.withColumn(key, _group_keys(lang, source)[0]).join(own, F.col(key) == F.col(group), "left").drop(key, group)
    ys: dict[str, Column] = {}
    for i, a in enumerate(DIMS):
        rest = reduce(lambda p, q: p + q, [F.col(v)[f"l_{a}_{k}"] * ys[k] for k in DIMS[:i]], F.lit(0.0))
        ys[a] = (vec[a] - F.col(v)[f"m_{a}"] - rest) / F.col(v)[f"l_{a}_{a}"]
    square = reduce(lambda p, q: p + q, [y * y for y in ys.values()])
    # one comparison, so that a filter on the verdict is not split and computed below the join a second time
    distance = F.when(bad, F.lit(float("inf"))).otherwise(F.coalesce(square, F.lit(0.0)))
    return joined.withColumn(d, distance).withColumns({failed: bad, kept: F.col(d) <= cut}).drop(v, d)
