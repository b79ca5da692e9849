"""URL filters: host and path rules first, then a character language-model ratio.

URLs that a rule allows and URLs that a rule blocks train two character models of variable order (contexts of up to
ORDER - 1 characters, Witten-Bell smoothing: each order leans on the next shorter one by its count of distinct successors).
The rest is judged by the difference of the two log-likelihoods per character, against a threshold calibrated on a fifth of the
ruled URLs, by hash, which the models don't learn from (the cut of a histogram with the largest gap between the rates of blocked
and of allowed URLs above it). Where that leaves a class empty on either side, models and threshold take all ruled URLs.

Defined cases: a null URL or one without `://` has empty host and path and, like any empty one, is allowed; equal URLs get
equal verdicts; if a rule class has no URL, everything unruled is allowed; an empty table gives an empty table; extra
columns are left out. Only DataFrame functions are used. Log ratios are summed as integers, so no sum depends on its order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import broadcast_if, temporary, written
from skerry.session import table

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4
FOLDS = 5  # of ruled URLs; one is held back for the threshold
ALPHABET = 256  # characters the shortest model spreads its last mass over
UNIT = 1_000_000  # integer log ratios: millionths
BROADCAST_ROWS = 400_000  # rows of n-gram ratios, of about 40 bytes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, F.lit("://")) + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, its action) of the longest rule that fits columns host and path; null where none does."""
    name = action = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        name, action = F.when(fits, f"{host}{path}").otherwise(name), F.when(fits, what).otherwise(action)
    return name, action


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per character of s: the ORDER characters that end in it."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), F.col("s"), F.lit("\x03"))
    return urls.select(*keep, padded.alias("p")).select(*keep, "p", F.explode(F.sequence(F.lit(1), F.char_length("p") - (ORDER - 1))).alias("i")).select(*keep, F.expr(f"substring(p, i, {ORDER})").alias("gram"))


def model(ruled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, gram, ratio): for every seen n-gram of every order k, the log of blocked over allowed probability; and (k, context,
    ratio) for unseen successors of a seen context, where the ratio is that of the escape masses, to be added to the shorter
    order's."""
    full = grams(ruled, "n", "blocked").groupBy("gram").agg(F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("blocked"), 0).otherwise(F.col("n"))).alias("a"))
    full = written(full, "url-grams")
    below: DataFrame | None = None
    out: list[DataFrame] = []
    escapes: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        counts = full.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        counts = counts.withColumn("context", F.expr(f"left(gram, {k - 1})"))
        contexts = counts.groupBy("context").agg(*(x for c in "ab" for x in (F.sum(c).alias(f"n{c}"), F.count_if(F.col(c) > 0).alias(f"t{c}"))))
        counts = counts.join(contexts, "context")
        if below is None:
            lower = counts.select("*", F.lit(1.0 / ALPHABET).alias("pa1"), F.lit(1.0 / ALPHABET).alias("pb1"))
        else:
            lower = counts.join(below, F.expr(f"right(gram, {k - 1})") == F.col("shorter")).drop("shorter")
        p = {c: F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}1")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"p{c}1")) for c in "ab"}
        now = written(lower.select("gram", p["a"].alias("pa"), p["b"].alias("pb")), f"url-model-{k}")
        out.append(now.select(F.lit(k).alias("k"), "gram", F.log(F.col("pb") / F.col("pa")).alias("ratio")))
        escape = {c: F.when(F.col(f"n{c}") > 0, F.col(f"t{c}") / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.lit(1.0)) for c in "ab"}
        escapes.append(contexts.select(F.lit(k).alias("k"), "context", F.log(escape["b"] / escape["a"]).alias("ratio")))
        below = now.select(F.col("gram").alias("shorter"), F.col("pa").alias("pa1"), F.col("pb").alias("pb1"))
    return written(reduce(DataFrame.union, out), "url-model"), written(reduce(DataFrame.union, escapes), "url-escapes")


def gram_ratios(distinct: DataFrame, ratios: DataFrame, escapes: DataFrame) -> DataFrame:
    """(gram, w): each gram's log ratio in millionths, from the longest order that knows it plus the escapes above it."""
    at = distinct
    for k in range(ORDER, 0, -1):
        seen = ratios.where(F.col("k") == k).select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        context = escapes.where(F.col("k") == k).select(F.col("context").alias(f"h{k}"), F.col("ratio").alias(f"e{k}"))
        at = at.join(seen, F.expr(f"right(gram, {k})") == F.col(f"g{k}"), "left")
        at = at.join(context, F.expr(f"left(right(gram, {k}), {k - 1})") == F.col(f"h{k}"), "left")
    value = F.lit(0.0)
    for k in range(1, ORDER + 1):
        value = F.coalesce(F.col(f"r{k}"), F.coalesce(F.col(f"e{k}"), F.lit(0.0)) + value)
    return at.select("gram", F.round(value * UNIT).cast("long").alias("w"))


def scores(urls: DataFrame, ruled: DataFrame) -> DataFrame:
    """(s, score): blocked minus allowed log-likelihood per character, in millionths, of every distinct s."""
    weights = written(gram_ratios(grams(urls).select("gram").distinct(), *model(ruled)), "url-weights")
    known = broadcast_if(weights, weights.count(), BROADCAST_ROWS)
    return grams(urls, "s").join(known, "gram").groupBy("s").agg(F.floor(F.sum("w") / F.count(F.lit(1))).cast("long").alias("score"))


def threshold(scored: DataFrame) -> int:
    """The score that best parts ruled URLs: largest rate of blocked above it minus rate of allowed above it. The histogram
    has steps of a hundredth and at most some thousand rows, as ratios per character are bounded by the smoothing."""
    step = UNIT // 100
    bars = scored.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("blocked"), 0).otherwise(F.col("n"))).alias("a"))
    above, every = Window.orderBy(F.desc("bin")), Window.partitionBy()
    gap = F.try_divide(F.sum("b").over(above), F.sum("b").over(every)) - F.try_divide(F.sum("a").over(above), F.sum("a").over(every))
    best = bars.select("bin", gap.alias("gap")).where(F.col("gap").isNotNull()).orderBy(F.desc("gap"), F.desc("bin")).first()
    return best["bin"] * step if best else 2**62


def judge(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, score) for every row of pages; score is null where a rule decides."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url")).select(id_col, host.alias("host"), path.alias("path"))
    name, action = rule_of(rules)
    rows = rows.select("*", name.alias("rule"), action.alias("action"), F.concat("host", "path").alias("s"))
    with temporary(pages.sparkSession):
        urls = written(rows.groupBy("s", "action").agg(F.count(F.lit(1)).alias("n")), "urls")
        ruled = urls.where("action IS NOT NULL").select("s", "n", (F.col("action") == "block").alias("blocked"))
        held = F.pmod(F.xxhash64("s"), F.lit(FOLDS)) == 0
        parted = ruled.groupBy("blocked", held.alias("held")).count().count() == 4
        every = written(scores(urls.select("s").distinct(), ruled.where(~held) if parted else ruled), "url-scores", keep=True)
        cut = threshold((ruled.where(held) if parted else ruled).join(every, "s"))
    method = F.when((F.col("s") != "") & (F.col("score") >= cut), "block").otherwise("allow")
    judged = rows.join(every, "s", "left")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("action", method).alias("verdict"), F.when(F.col("action").isNull(), F.col("score")).alias("score"))


def op1_url_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's URL. The URL text is deduplicated and counted before anything is shuffled by it."""
    return judge(table(spark, sf_dir, "pages"))
