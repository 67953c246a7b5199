"""URL filter: rules first, then the ratio of two character language models.

The longest rule whose host is the URL's host or a parent domain of it, and whose path begins the
URL's path, decides. The URLs that rules accept and reject train two smoothed variable-order Markov
models over characters; for a URL without a rule each character is judged in the longest context (two
characters at most) in which either side has seen it, the log-likelihood differences are averaged
over the length, and the average is compared with a threshold calibrated on a held-back fifth of the
ruled URLs, where the mean of both error rates is least.

Characters are folded to an alphabet of 39, so a model has at most 39 + 39^2 + 39^3 = 60,879 entries
whatever the corpus: that bound is what allows its broadcast. Everything is DataFrame functions.

Null URLs and URLs without ``://`` have an empty host and path and meet no rule; empty ones score 0;
without accepted or rejected URLs every score is 0 and the threshold 0, which allows; repeated rows
are judged alike and counted each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import pinned

#: Letters, a digit, ten signs, one for all other characters, and the one before the beginning.
ALPHABET = 39
ORDER = 3
BINS = 100  # of a threshold unit


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, F.lit("://")) + 3)).otherwise(F.lit(""))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule, like ``net/en/``; null without one. ``rules``: (rule, verdict)."""
    chosen = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        chosen = F.when(fits, rule).otherwise(chosen)
    return chosen


def _folded(url: Column) -> Column:
    plain = F.regexp_replace(_lower(F.coalesce(url, F.lit(""))), r"[^a-z0-9/.\-_?=&#:%]", "~")
    return F.regexp_replace(plain, "[0-9]", "0")


def _grams(text: Column) -> Column:
    """Each character with the two before it."""
    padded = F.concat(F.lit("^^"), text)
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(padded, i, ORDER))


def model(texts: DataFrame) -> DataFrame:
    """(gram, delta): log-likelihood difference of the last character of each gram of 1 to 3, from (text, accepted)."""
    each = texts.select("accepted", F.explode(_grams(F.col("text"))).alias("g"))
    whole = each.groupBy("g").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("b"))
    every = whole.select(F.explode(F.array(*[F.substring("g", ORDER - k + 1, k) for k in range(1, ORDER + 1)])).alias("gram"), "a", "b")
    counts = pinned(every.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    size = F.length("gram")
    context = F.expr("left(gram, length(gram) - 1)")
    contexts = counts.groupBy(context.alias("context")).agg(
        F.sum("a").alias("a_all"), F.sum("b").alias("b_all"), F.count_if(F.col("a") > 0).alias("a_kinds"), F.count_if(F.col("b") > 0).alias("b_kinds")
    )
    joined = counts.withColumn("context", context).join(contexts, "context")
    smoothed = joined.where(size == 1).select(
        "gram",
        ((F.col("a") + 1) / (F.col("a_all") + ALPHABET)).alias("p"),
        ((F.col("b") + 1) / (F.col("b_all") + ALPHABET)).alias("q"),
    )
    tables = [smoothed]
    for length in range(2, ORDER + 1):
        shorter = tables[-1].select(F.col("gram").alias("shorter"), F.col("p").alias("p_less"), F.col("q").alias("q_less"))
        rows = joined.where(size == length).withColumn("shorter", F.expr("substr(gram, 2)")).join(shorter, "shorter")

        def backed(n: str, less: str) -> Column:
            total, kinds = F.col(f"{n}_all"), F.col(f"{n}_kinds")
            return F.when(total == 0, F.col(less)).otherwise((F.col(n) + kinds * F.col(less)) / (total + kinds))

        tables.append(rows.select("gram", backed("a", "p_less").alias("p"), backed("b", "q_less").alias("q")))
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return union.select("gram", (F.log("p") - F.log("q")).alias("delta"))


def scored(pages: DataFrame, grams: DataFrame, *keep: str) -> DataFrame:
    """Add ``score`` to rows with ``text``: the mean difference over their characters, 0 for none."""
    exploded = pages.withColumn("uid", F.monotonically_increasing_id()).select(
        "uid", *keep, F.explode_outer(_grams(F.col("text"))).alias("g")
    )
    for k in range(1, ORDER + 1):
        # At most ALPHABET**k rows.
        part = grams.where(F.length("gram") == k).select(F.col("gram").alias("gram"), F.col("delta").alias(f"d{k}"))
        exploded = exploded.join(F.broadcast(part), F.substring("g", ORDER - k + 1, k) == F.col("gram"), "left").drop("gram")
    delta = F.coalesce(*[f"d{k}" for k in range(ORDER, 0, -1)])
    return exploded.groupBy("uid", *keep).agg(F.coalesce(F.avg(F.when(F.col("g").isNotNull(), F.coalesce(delta, F.lit(0.0)))), F.lit(0.0)).alias("score")).drop("uid")


def _bin(score: Column) -> Column:
    return F.greatest(F.lit(-10 * BINS), F.least(F.lit(10 * BINS), F.floor(F.round(score, 6) * BINS))).cast("int")


def threshold(calibration: DataFrame) -> DataFrame:
    """One row: the bin from which on URLs are accepted, from (score, accepted); no row without both kinds."""
    bins = calibration.groupBy(_bin(F.col("score")).alias("bin")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("b"))
    # At most 20 * BINS + 1 rows reach this window.
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rates = bins.select(
        "bin",
        F.try_divide(F.coalesce(F.sum("a").over(below), F.lit(0)), F.sum("a").over(whole)).alias("lost"),
        (1 - F.try_divide(F.coalesce(F.sum("b").over(below), F.lit(0)), F.sum("b").over(whole))).alias("let_in"),
    )
    wrong = F.round(F.col("lost") + F.col("let_in"), 9)
    return rates.where(wrong.isNotNull()).orderBy(wrong, F.abs("bin"), "bin").limit(1).select("bin")


def judged(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, score."""
    own = pages.select(F.col(key).alias("id"), F.col(url).alias("url"))
    parts = own.select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _folded(F.col("url")).alias("text"),
        (F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1) < "3").alias("held_back"),
    ).withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    said = F.create_map(*[F.lit(x) for rule in rules for x in rule])[F.col("rule")] if rules else F.lit(None).cast("string")
    parts = parts.withColumn("accepted", said == "allow")
    decided = F.col("rule").isNotNull()
    grams = pinned(model(parts.where(decided & ~F.col("held_back")).select("accepted", "text")))
    least = threshold(scored(parts.where(decided & F.col("held_back")), grams, "accepted"))
    marked = scored(parts, grams, "id", "host", "path", "rule", "accepted")
    allowed = F.coalesce("accepted", _bin(F.col("score")) >= F.coalesce(least.scalar(), F.lit(0)))
    return marked.select(
        F.col("id").alias(key), "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"), "score"
    )
