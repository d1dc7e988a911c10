"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Everything is DataFrame and SQL functions.  The statistics of a text are computed in its row; the estimates are
aggregates per group that are joined back to the rows.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import GAP, text_or_empty, written

# The symbols counted, and the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 0.5

#: Transformed statistics and the least standard deviation that is believed of each.
SPREADS = {"word_length": 0.1, "symbols": 0.3, "capitals": 0.3, "repeats": 1.0, "dup_lines": 1.5}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and the counts of each text: words, their characters, symbols, repeated lines, and words in repeated
    3-word windows; also capitals and lines with a word.

    A window is found again by sorting (hash of the window, place) within the row, so the work grows as n log n.
    """
    out = docs.select(*keep, text.alias("_text")).withColumn("_bare", F.trim(F.regexp_replace("_text", GAP, " ")))
    kept = [c for c in out.columns if c not in ("_text", "_bare")]
    out = out.select(
        *kept,
        F.length("_bare").alias("_length"),
        F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", " ")).alias("_words"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    kept += ["n_symbols", "n_capitals"]
    size = F.size("_words")
    window = F.when(size >= 3, F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.struct(F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)).alias("h"), i.alias("i"))))
    out = out.select(
        *kept,
        size.cast("long").alias("n_words"),
        F.when(size > 0, F.col("_length") - size + 1).otherwise(0).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.coalesce(window, F.array().cast("array<struct<h:bigint,i:int>>"))).alias("_windows"),
    )
    kept += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    same = lambda x, j: F.coalesce(F.get("_windows", j)["h"] == x["h"], F.lit(False))
    again = F.filter("_windows", lambda x, j: same(x, j + 1) | same(x, j - 1))
    out = out.select(*kept, F.sort_array(F.transform(again, lambda x: x["i"])).alias("_places"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p.cast("long"))).alias("n"), (p + F.lit(3)).cast("long").alias("end"))
    return out.select(*kept, F.aggregate("_places", none, step, lambda a: a["n"]).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))


def chi_square(share: float, degrees: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty's approximation)."""
    z = NormalDist().inv_cdf(share)
    return degrees * (1 - 2 / (9 * degrees) + z * (2 / (9 * degrees)) ** 0.5) ** 3


def farthest(n: Column, degrees: int, alpha: float) -> Column:
    """The squared distance that a new row of a group passes with probability ``alpha``, where ``n`` rows gave the estimate:
    Hotelling's, with Paulson's approximation of the F quantile.  It falls to the chi-square quantile as n grows; null where
    so few rows bound nothing at ``alpha``.
    """
    z2 = NormalDist().inv_cdf(1 - alpha) ** 2
    a, b = 2 / (9 * degrees), 2 / (9 * F.greatest(n - degrees, F.lit(1e-3)))
    lead, middle, rest = (1 - b) * (1 - b) - z2 * b, (1 - a) * (1 - b), (1 - a) ** 2 - z2 * a
    root = (middle + F.sqrt(middle * middle - lead * rest)) / lead
    return F.when((n > degrees) & (lead > 0), degrees * (n + 1) * (n - 1) / (n * (n - degrees)) * root * root * root)


def _statistics() -> dict[str, Column]:
    per = lambda part, whole: F.log1p(100 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return {
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": per("n_symbols", "n_words"),
        "capitals": per("n_capitals", "word_chars"),
        "repeats": per("n_repeat_words", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
    }


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _cholesky(groups: DataFrame, p: int, keep: list[str]) -> DataFrame:
    """``keep``, the centre m0, m1 ... and the lower factor l00, l10 ... of each group's covariance c00, c10 ..."""
    out = groups
    for i, j in _pairs(p):
        value = F.col(f"c{i}{j}")
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        value = F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}")
        out = out.withColumn(f"l{i}{j}", value)
    return out.select(*keep, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i, j in _pairs(p)])


def _covariance(p: int, spreads: list[float], scale: float = 1.0) -> list[Column]:
    """c00, c10 ... of means m0 ... and means of products s00 ..., scaled and with the least variances added."""
    out = []
    for i, j in _pairs(p):
        value = scale * (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))
        out.append((F.greatest(value, F.lit(0.0)) + spreads[i] ** 2 if i == j else value).alias(f"c{i}{j}"))
    return out


def _distance(rows: DataFrame, p: int) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    out = rows
    for i in range(p):
        value = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", value / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0")))


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str], small: bool, how: str = "inner", salts: int = 64) -> DataFrame:
    """``rows`` with the columns of their group, without dealing rows by group: a ``small`` table of groups is broadcast, a
    larger one meets the rows in ``salts`` copies, dealt by a hash of the columns ``spread`` as well."""
    if small:
        return rows.join(F.broadcast(groups), keys, how)
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts))).join(copies, [*keys, "_salt"], how).drop("_salt")


def quantiles(rows: DataFrame, keys: list[str], value: Column, share: float, step: float) -> DataFrame:
    """(keys, bin): the first bin of width ``step`` up to which at least ``share`` of a group's values lie.

    Counts by bin are integers, so the result doesn't depend on the order of tasks; they have map-side partial sums and
    are dealt by bin too, so a group of any size is spread.  Only its bins meet in one task.
    """
    bins = rows.groupBy(*keys, F.floor(value / step).cast("long").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    placed = bins.select(*keys, "_bin", F.sum("_n").over(whole.orderBy("_bin")).alias("_upto"), F.sum("_n").over(whole).alias("_all"))
    return placed.where(F.col("_upto") >= share * F.col("_all")).groupBy(*keys).agg(F.min("_bin").alias("bin"))


#: Widths of the bins for medians, and for logarithms of squared distances.
FINE, COARSE = 1 / 256, 1 / 64


def _nearness() -> Column:
    return F.log(F.greatest(F.col("d2"), F.lit(1e-6)))


def _starts(rows: DataFrame, p: int, keys: list[str], spreads: list[float], draws: int) -> DataFrame:
    """(keys, _start, centre, factor): medians with the least spreads, the moments of all rows, and those of ``draws`` random
    sets of p + 1 rows, the ones with the smallest hashes of their values."""
    xs = [F.col(f"x{i}") for i in range(p)]
    hashed = lambda k, d: F.xxhash64(F.lit(k * (p + 1) + d), *xs)
    drawn = [F.min_by(xs[i], hashed(k, d)).alias(f"r{k}_{d}_{i}") for k in range(draws) for d in range(p + 1) for i in range(p)]
    sums = rows.groupBy(*keys).agg(*[F.avg(xs[i]).alias(f"a{i}") for i in range(p)], *[F.avg(xs[i] * xs[j]).alias(f"b{i}{j}") for i, j in _pairs(p)], *drawn)
    long = rows.select(*keys, F.posexplode(F.array(*xs)).alias("_which", "_value"))
    mid = quantiles(long, [*keys, "_which"], F.col("_value"), 0.5, FINE)
    mid = mid.groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == i, (F.col("bin") + 0.5) * FINE)).alias(f"d{i}") for i in range(p)])

    def start(number: int, means: list[Column], products: list[Column]) -> Column:
        return F.struct(F.lit(number).alias("_start"), *[m.alias(f"m{i}") for i, m in enumerate(means)], *[s.alias(f"s{i}{j}") for (i, j), s in zip(_pairs(p), products, strict=True)])

    over = lambda values: sum(values[1:], values[0]) / len(values)
    every = [
        start(0, [F.col(f"d{i}") for i in range(p)], [F.col(f"d{i}") * F.col(f"d{j}") for i, j in _pairs(p)]),
        start(1, [F.col(f"a{i}") for i in range(p)], [F.col(f"b{i}{j}") for i, j in _pairs(p)]),
    ]
    for k in range(draws):
        r = [[F.col(f"r{k}_{d}_{i}") for d in range(p + 1)] for i in range(p)]
        every.append(start(2 + k, [over(v) for v in r], [over([x * y for x, y in zip(r[i], r[j], strict=True)]) for i, j in _pairs(p)]))
    begun = sums.join(mid, keys).select(*keys, F.explode(F.array(*every)).alias("_s")).select(*keys, "_s.*")
    begun = begun.select(*keys, "_start", *[f"m{i}" for i in range(p)], *_covariance(p, spreads))
    return _cholesky(begun, p, [*keys, "_start"])


def robust_outliers(rows: DataFrame, names: list[str], keys: list[str], spreads: dict[str, float], share: float = 0.75, draws: int = 2, first: int = 2, steps: int = 3, reweigh: float | None = 0.975, most_broadcast: int = 20_000) -> DataFrame:
    """(keys, n, centre m, factor l): minimum covariance determinant estimates of columns x0, x1 ... of each group.

    Each group has several starts: its medians, the moments of all of its rows, and ``draws`` random sets of rows.  A
    concentration step keeps the ``share`` of a group's rows that are nearest, up to the width of a bin, and takes their mean
    and covariance, which lowers the determinant.  All starts make ``first`` steps, the one with the least determinant goes
    on for ``steps``; the covariance is scaled to what it is for normal data.  Last, the rows within the chi-square quantile
    of ``reweigh`` give the moments, scaled likewise (None: not), so that a group with few outliers is not taken for wider.

    Every step is two aggregates with map-side partial results over all rows.  Estimates are a row per group and start; up
    to ``most_broadcast`` groups they are broadcast, beyond that they meet salted rows.
    """
    p, least = len(names), [spreads[n] for n in names]
    xs, each = [f"x{i}" for i in range(p)], [*keys, "_start"]
    sizes = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "groups")
    small = sizes.count() <= most_broadcast

    def near(table: DataFrame) -> DataFrame:
        return _distance(attach(rows, table, keys, xs, small), p)

    def moments(inside: DataFrame, part: float) -> DataFrame:
        # Products are taken about the last centre, so that no digits cancel.
        about = {i: F.col(f"x{i}") - F.col(f"m{i}") for i in range(p)}
        sums = inside.groupBy(*each).agg(*[F.first(f"m{i}").alias(f"o{i}") for i in range(p)], *[F.avg(y).alias(f"m{i}") for i, y in about.items()], *[F.avg(about[i] * about[j]).alias(f"s{i}{j}") for i, j in _pairs(p)])
        covariance = _covariance(p, least, part / _inner_share(chi_square(part, p), p))
        return _cholesky(sums.select(*each, *[(F.col(f"o{i}") + F.col(f"m{i}")).alias(f"m{i}") for i in range(p)], *covariance), p, each)

    estimate = written(_starts(rows, p, keys, least, draws), "starts")
    for step in range(first + steps):
        limits = written(estimate.join(quantiles(near(estimate), each, _nearness(), share, COARSE), each), "limits")
        estimate = moments(near(limits).where(F.floor(_nearness() / COARSE) <= F.col("bin")), share)
        if step == first - 1:
            size = sum((F.log(f"l{i}{i}") for i in range(1, p)), F.log("l00"))
            best = F.row_number().over(Window.partitionBy(*keys).orderBy(size, "_start"))
            estimate = estimate.withColumn("_best", best).where("_best = 1").drop("_best")
        estimate = written(estimate, f"estimate{step}")
    if reweigh is not None:
        estimate = written(moments(near(estimate).where(F.col("d2") <= chi_square(reweigh, p)), reweigh), "reweighed")
    return sizes.join(estimate.drop("_start"), keys)


def _inner_share(cut: float, p: int) -> float:
    """Share of a chi-square variable with p + 2 degrees that is below ``cut``: E[x'x; inside] / p for normal data."""
    z = ((cut / (p + 2)) ** (1 / 3) - 1 + 2 / (9 * (p + 2))) / (2 / (9 * (p + 2))) ** 0.5
    return NormalDist().cdf(z)


def _blend(own: DataFrame, p: int, n: Column, other: Column, keep: list[Column], wide: dict[str, Column]) -> DataFrame:
    """Estimates of ``n`` rows weighed with ``wide`` ones (m0 ..., c00 ...) that count as ``other`` rows."""
    part = lambda name: ((n * F.col(name) + other * wide[name]) / (n + other)).alias(name)
    return own.select(*keep, (n + other).alias("n"), *[part(f"m{i}") for i in range(p)], *[part(f"c{i}{j}") for i, j in _pairs(p)])


def shrunk(estimates: DataFrame, p: int, strength: float) -> DataFrame:
    """(_lang, _source, n, centre, factor) of estimates at three levels: each language's is weighed with that of all rows, and
    each language and source's with its language's, which counts as ``strength`` rows, or as many as it has beyond the
    group's own.  ``n`` is the sum of these weights.  The one row of all comes to the driver."""
    product = {(i, j): sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(1, j + 1)), F.col(f"l{i}0") * F.col(f"l{j}0")) for i, j in _pairs(p)}
    names = [f"m{i}" for i in range(p)] + [f"c{i}{j}" for i, j in _pairs(p)]
    full = written(estimates.select("_level", "_lang", "_source", "n", *[f"m{i}" for i in range(p)], *[c.alias(f"c{i}{j}") for (i, j), c in product.items()]), "levels")
    top = full.where("_level = 2").first()
    if top is None:
        return _cholesky(full.limit(0), p, ["_lang", "_source", "n"])
    n = F.col("n").cast("double")
    langs = _blend(full.where("_level = 1"), p, n, F.least(F.lit(float(strength)), F.lit(float(top["n"])) - n), [F.col("_lang")], {c: F.lit(float(top[c])) for c in names})
    wide = langs.select(F.col("_lang").alias("_wide_lang"), F.col("n").alias("_wide_n"), *[F.col(c).alias(f"_wide_{c}") for c in names])
    fine = full.where("_level = 0").join(wide, F.col("_lang") == F.col("_wide_lang"))
    beyond = F.least(F.lit(float(strength)), F.col("_wide_n") - n)
    fine = _blend(fine, p, n, beyond, [F.col("_lang"), F.col("_source")], {c: F.col(f"_wide_{c}") for c in names})
    return _cholesky(fine, p, ["_lang", "_source", "n"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", alpha: float = 1e-9, strength: float = 100.0, share: float = 0.75, carry: tuple[str, ...] = (), most_broadcast: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance,
    kept, and the columns named in ``carry``.

    Rows that pass the base rules are judged by the robust distance of their statistics from their language and source; a
    distance that such rows pass with probability ``alpha`` rejects.  Estimates are made for each language and source, each
    language, and all rows; the finer ones are weighed with the wider ones, which count as ``strength`` rows, so groups of
    every size are treated alike, and the bound is wider the fewer rows an estimate stands on: a handful rejects nothing.
    Null texts count as empty, which fail the base rules; null languages and sources are groups of their own; ids may be
    null or repeat; repeated rows count as often as they come; without documents there is no row.  Other columns are not
    read.
    """
    text = text_or_empty(text_col)
    keep = [F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("_lang"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_source"), *[F.col(c).alias(f"_carry_{c}") for c in carry]]
    counted = text_counts(docs, text, keep).withColumn("base_failed", base_failed())
    stats = _statistics()
    names = list(stats)
    p = len(names)
    counted = written(counted.select("*", *[s.alias(f"x{i}") for i, s in enumerate(stats.values())]), "counts")
    xs = [f"x{i}" for i in range(p)]
    level = lambda n, lang, source: F.struct(F.lit(n).alias("_level"), lang.alias("_lang"), source.alias("_source"))
    lang, source, none = F.col("_lang"), F.col("_source"), F.lit("")
    levels = F.explode(F.array(level(0, lang, source), level(1, lang, none), level(2, none, none))).alias("_at")
    judged = counted.where(~F.col("base_failed")).select(levels, *xs).select("_at.*", *xs)
    estimates = robust_outliers(judged, names, ["_level", "_lang", "_source"], SPREADS, share, most_broadcast=most_broadcast)
    known = written(shrunk(estimates, p, strength), "known")
    small = known.count() <= most_broadcast
    scored = _distance(attach(counted, known.withColumnRenamed("n", "_stands_on"), ["_lang", "_source"], xs, small, "left"), p)
    far = F.coalesce(F.col("d2") > farthest(share * F.col("_stands_on"), p, alpha), F.lit(False))
    return scored.select(F.col("_id").alias(id_col), *COUNTS, "base_failed", F.when(~F.col("base_failed"), F.sqrt("d2")).alias("distance"), (~F.col("base_failed") & ~far).alias("kept"), *[F.col(f"_carry_{c}").alias(c) for c in carry])
