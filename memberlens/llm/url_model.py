"""URL filter: rules, and for the rest a ratio of two character language models.

The URLs that rules decide train two variable-order Markov models, one of accepted and one
of rejected URLs, smoothed by interpolation with shorter contexts (Witten-Bell). Both live
in one table of distinct character n-grams, so that scoring is a join. A URL's score is the
mean over its characters of the log-likelihood difference; the limit between allow and
block comes from decided URLs that the models have not seen. Built-in expressions only.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.llm.scratch import saved

ALLOW, BLOCK = "allow", "block"
#: Characters of an n-gram: the longest context and what follows it.
GRAM = 5
START, STOP = "\x02", "\x03"
#: Probability of a character before anything is known.
FLOOR = 1 / 256
#: One in so many decided URLs is kept for setting the limit.
HELD_OUT = 5
#: Scores are told apart this finely when the limit is set, and cut at this size.
STEP, REACH = 0.01, 10


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null or a url without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, k), F.lit("")) for k in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """verdict and rule of the longest (verdict, rule) that fits, else null.

    A rule is a host, a slash and the beginning of a path; it fits subdomains too. Of two
    rules of one length that fit, block wins.
    """
    by_length = sorted(rules, key=lambda r: (-len(r[1]), r[0] != BLOCK, r[1]))
    found = []
    for verdict, rule in by_length:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*found)


def _grams(text: Column) -> Column:
    """Each character, and the stop, behind the characters before it."""
    padded = F.concat(F.lit(START * (GRAM - 1)), text, F.lit(STOP))
    places = F.sequence(F.lit(1), F.char_length(text) + 1)
    return F.transform(places, lambda at: F.substr(padded, at, F.lit(GRAM)))


def ratio_table(grams: DataFrame) -> DataFrame:
    """gram and ratio, its log-likelihood difference, from gram, accepted and rejected counts."""
    kinds = ("accepted", "rejected")
    levels = {GRAM: grams}
    for k in range(GRAM - 1, 0, -1):
        tail = F.expr("substring(gram, 2)").alias("gram")
        levels[k] = levels[k + 1].groupBy(tail).agg(*(F.sum(c).alias(c) for c in kinds))
    below = None
    for k in range(1, GRAM + 1):
        context = F.substring("gram", 1, k - 1).alias("context")
        of_context = levels[k].groupBy(context).agg(
            *(F.sum(c).alias(f"{c}_all") for c in kinds),
            *(F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in kinds),
        )
        rows = levels[k].select("*", context, F.expr("substring(gram, 2)").alias("tail"))
        rows = rows.join(of_context, "context")
        if below is None:
            rows = rows.select("*", *(F.lit(FLOOR).alias(f"{c}_below") for c in kinds))
        else:
            shorter = [F.col(f"p_{c}").alias(f"{c}_below") for c in kinds]
            rows = rows.join(below.select(F.col("gram").alias("tail"), *shorter), "tail")

        def smoothed(c: str) -> Column:
            seen, more = F.col(f"{c}_all"), F.col(f"{c}_kinds")
            mixed = (F.col(c) + more * F.col(f"{c}_below")) / (seen + more)
            return F.when(seen > 0, mixed).otherwise(F.col(f"{c}_below")).alias(f"p_{c}")

        below = rows.select("gram", *(smoothed(c) for c in kinds))
    return below.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def scores(urls: DataFrame) -> DataFrame:
    """url, known (a verdict, or null) and score of each distinct text of a URL to be judged.

    ``urls`` has url, known and n, how often it occurs. Judged are URLs without a verdict
    and the held-out ones of those with one.
    """
    held_out = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    spelt = urls.select(
        F.unhex(F.md5("url")).alias("key"), "url", "known", "n", held_out.alias("held_out")
    )
    each = spelt.select("key", "known", "n", "held_out", F.explode(_grams(F.col("url"))).alias("gram"))

    def seen(verdict: str) -> Column:
        return F.sum(F.when((F.col("known") == verdict) & ~F.col("held_out"), F.col("n")).otherwise(0))

    counts = each.groupBy("gram").agg(seen(ALLOW).alias("accepted"), seen(BLOCK).alias("rejected"))
    table = saved(ratio_table(saved(counts)))
    judged = F.col("known").isNull() | F.col("held_out")
    means = each.filter(judged).join(table, "gram").groupBy("key").agg(F.avg("ratio").alias("score"))
    return spelt.filter(judged).join(means, "key").select("url", "known", "n", "score")


def limit(scored: DataFrame) -> float:
    """The score at which the held-out URLs are told apart best, both verdicts counting alike.

    Without held-out URLs of either verdict it is 0.
    """
    bin_ = F.round(F.greatest(F.least("score", F.lit(REACH)), F.lit(-REACH)) / STEP).cast("int")
    bins = (
        scored.filter("known is not null")
        .groupBy(bin_.alias("bin"))
        .agg(*(F.sum(F.when(F.col("known") == v, F.col("n")).otherwise(0)).alias(v) for v in (ALLOW, BLOCK)))
        .collect()
    )
    rows = sorted((r["bin"], r[ALLOW], r[BLOCK]) for r in bins)
    allowed, blocked = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allowed or not blocked:
        return 0.0
    best, at, kept, stopped = 0.0, 0.0, allowed, 0
    for (place, a, b), above in zip(rows, [*rows[1:], (rows[-1][0] + 1, 0, 0)], strict=True):
        kept, stopped = kept - a, stopped + b
        if kept / allowed + stopped / blocked > best:
            best, at = kept / allowed + stopped / blocked, (place + above[0]) / 2 * STEP
    return at


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str]], *, url: str = "url", id: str = "page_id"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict and score.

    A rule's verdict stands; elsewhere a score below the limit blocks. ``score`` is null
    where a rule decides. Rules look at host and path, the models at the whole url, with a
    null as empty: pages of one url get one verdict, and a page without a host is judged by
    the models like any other.
    """
    host, path = host_and_path(F.col(url))
    whole = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(F.col(id).alias("page"), host.alias("host"), path.alias("path"), whole.alias("url"))
    rows = rows.withColumn("ruled", longest_rule(F.col("host"), F.col("path"), rules))
    urls = rows.groupBy("url", F.col("ruled.verdict").alias("known")).agg(F.count(F.lit(1)).alias("n"))
    scored = saved(scores(urls))
    lowest = limit(scored)
    verdicts = scored.filter("known is null").select("url", "score")
    by_score = F.when(F.col("score") < lowest, BLOCK).otherwise(ALLOW)
    return rows.join(verdicts, "url", "left").select(
        F.col("page").alias(id),
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", by_score).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("score")).alias("score"),
    )
