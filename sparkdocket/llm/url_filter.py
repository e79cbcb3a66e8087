"""URL filter: rules first, then a ratio of two character language models.

Rules name a host and a path prefix; the longest that fits decides.  The URLs
that rules allow and block are the training texts of two variable-order Markov
models over characters.  Contexts of 0 to ``max_order`` characters are counted
over all of them by a Spark aggregation, all counts are kept in written tables,
and URLs are scored by joins to them, so that the models grow with the input and
nothing of them is broadcast.  A character's probability mixes the estimates of
its contexts from short to long (Witten-Bell smoothing).  The score of a URL is
the difference of the two log-likelihoods per character; the threshold is the one
at which all training URLs of the two kinds are told apart with the fewest
weighted errors.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdocket.llm.columns import add_columns
from sparkdocket.plans.staging import stage

#: (verdict, host, path prefix) of the production list.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_START, _END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule (host + path) that decides and its verdict; nulls where none fits.

    The longest rule wins; of equally long ones the last in the list.
    """
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


@dataclass
class MarkovModel:
    """Counts of followers per context, for scoring one text at a time."""

    order: int
    alphabet: int
    followers: dict[str, dict[str, int]] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)
    memo: dict[str, float] = field(default_factory=dict)

    def log_prob(self, context: str, char: str) -> float:
        key = context + char
        known = self.memo.get(key)
        if known is None:
            p = 1.0 / self.alphabet
            for n in range(len(context) + 1):
                seen = self.followers.get(context[len(context) - n :])
                if seen is None:
                    break
                total = self.totals[context[len(context) - n :]]
                p = (seen.get(char, 0) + len(seen) * p) / (total + len(seen))
            known = log(p)
            if len(self.memo) < 500_000:
                self.memo[key] = known
        return known

    def score(self, text: str) -> float:
        """Log-likelihood of a text with its end mark."""
        padded = _START + text + _END
        return sum(self.log_prob(padded[max(0, k - self.order) : k], padded[k]) for k in range(1, len(padded)))


@dataclass
class UrlModel:
    allow: MarkovModel
    block: MarkovModel
    threshold: float = 0.0

    def ratio(self, url: str | None) -> float:
        """Log-likelihood difference per character (0 for a null or empty URL)."""
        text = url or ""
        if not text:
            return 0.0
        return (self.allow.score(text) - self.block.score(text)) / (len(text) + 1)


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """Counts of (kind, context, char) over all rows, by built-in functions."""
    padded = F.concat(F.lit(_START), F.col("url"), F.lit(_END))
    at = F.explode(F.sequence(F.lit(2), F.length("padded"))).alias("at")
    n = F.explode(F.sequence(F.lit(0), F.least(F.lit(order), F.col("at") - 1))).alias("n")
    spots = urls.select("kind", "copies", padded.alias("padded")).select("kind", "copies", "padded", at).select("*", n)
    return spots.groupBy(
        "kind",
        F.substring(F.col("padded"), F.col("at") - F.col("n"), F.col("n")).alias("context"),
        F.substring(F.col("padded"), F.col("at"), F.lit(1)).alias("char"),
    ).agg(F.sum("copies").alias("c"))


def _training(labelled: DataFrame) -> DataFrame:
    return _dealt(labelled.where("url IS NOT NULL AND url <> ''").groupBy("kind", "url").agg(F.count(F.lit(1)).alias("copies")))


def _dealt(urls: DataFrame) -> DataFrame:
    """URLs over all tasks: a small table becomes hundreds of times as many rows, one per character and context."""
    return urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url")


def fit_url_models(labelled: DataFrame, *, max_order: int = 5, min_context: int = 1) -> UrlModel:
    """Fit on rows ``url, kind`` (``allow`` or ``block``), for a training table whose counts fit in memory.

    All rows are counted and set the threshold.  A kind without URLs gets the uniform model.
    """
    urls = _training(labelled)
    grams = stage(_grams(urls, max_order), "url-grams").df
    totals = grams.groupBy("kind", "context").agg(F.sum("c").alias("total")).where((F.length("context") <= 1) | (F.col("total") >= min_context))
    models = {k: MarkovModel(max_order, 256) for k in ("allow", "block")}
    for r in grams.join(totals.select("kind", "context"), ["kind", "context"]).toLocalIterator():
        m = models[r["kind"]]
        m.followers.setdefault(r["context"], {})[r["char"]] = r["c"]
        m.totals[r["context"]] = m.totals.get(r["context"], 0) + r["c"]
    model = UrlModel(models["allow"], models["block"])
    scored = [(model.ratio(r["url"]), r["kind"] == "allow") for r in urls.toLocalIterator()]
    model.threshold = best_threshold(labelled.sparkSession.createDataFrame(scored, "score double, good boolean"))
    for m in models.values():
        m.memo = {}
    return model


def best_threshold(scored: DataFrame) -> float:
    """The threshold on ``score`` below which the rows not ``good`` lie, with the fewest errors; both kinds count the same.

    Exact: running counts within ranges of scores, after the totals of the ranges below.
    """
    per = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    per = stage(per.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "url-ranges").df
    parts = per.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("score").alias("low")).orderBy("part").collect()
    good, bad = sum(r["good"] for r in parts), sum(r["bad"] for r in parts)
    if not (good and bad):
        return 0.0
    below, seen_good, seen_bad = [], 0, 0
    for k, r in enumerate(parts):
        below.append((r["part"], seen_good, seen_bad, parts[k + 1]["low"] if k + 1 < len(parts) else None))
        seen_good, seen_bad = seen_good + r["good"], seen_bad + r["bad"]
    offsets = scored.sparkSession.createDataFrame(below, "part int, good0 long, bad0 long, next_low double")
    w = Window.partitionBy("part").orderBy("score")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cost = 1 + (F.col("good0") + F.sum("good").over(run)) / good - (F.col("bad0") + F.sum("bad").over(run)) / bad
    following = F.coalesce(F.lead("score").over(w), "next_low")
    costs = per.join(F.broadcast(offsets), "part").select(F.round(cost, 12).alias("cost"), "score", following.alias("following"))
    best = costs.where("following IS NOT NULL").agg(F.min(F.struct("cost", "score", "following")).alias("b")).first()["b"]
    return (best["score"] + best["following"]) / 2 if best is not None and best["cost"] < 1 else parts[0]["low"]


def _scored_urls(pages: DataFrame, max_order: int, min_context: int) -> DataFrame:
    """``url, kind, score`` of each distinct URL of rows ``url, kind`` (null where no rule decides)."""
    grams = _grams(_training(pages.where("kind IS NOT NULL")), max_order)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)).alias(f"c_{k}")
    grams = stage(grams.groupBy("context", "char").agg(of("allow"), of("block")), "url-grams").df
    sums = [x for k in ("allow", "block") for x in (F.sum(f"c_{k}").alias(f"t_{k}"), F.count_if(F.col(f"c_{k}") > 0).alias(f"u_{k}"))]
    totals = grams.groupBy("context").agg(*sums)

    urls = pages.where("url IS NOT NULL AND url <> ''").select("url", "kind").distinct()
    urls = stage(_dealt(urls).withColumn("id", F.monotonically_increasing_id()), "url-texts").df
    padded = F.concat(F.lit(_START), F.col("url"), F.lit(_END))
    at = F.col("at")
    spots = urls.select("id", padded.alias("padded"), F.explode(F.sequence(F.lit(2), F.length(padded))).alias("at"))
    before = F.least(F.lit(max_order), at - 1)
    spots = spots.select("id", F.substring("padded", at - before, before).alias("context"), F.substring("padded", at, F.lit(1)).alias("char"))
    # Distinct pairs of all orders: a context has as many as there are characters at most, so no key is hot.
    pairs = spots.select("context", "char").distinct().select("char", F.col("context").alias("whole"), F.explode(F.sequence(F.lit(0), F.length("context"))).alias("n"))
    pairs = pairs.select("n", F.substring("whole", F.length("whole") - F.col("n") + 1, F.col("n")).alias("context"), "char").distinct()
    pairs = stage(pairs.join(totals, "context", "left").join(grams, ["context", "char"], "left"), "url-pairs").df

    def mixed(k: str, shorter: Column) -> Column:
        t, u, c = F.col(f"t_{k}"), F.col(f"u_{k}"), F.coalesce(f"c_{k}", F.lit(0))
        known = (t > 0) & ((F.col("n") <= 1) | (t >= min_context))
        return F.when(known, (c + u * shorter) / (t + u)).otherwise(shorter).alias(f"p_{k}")

    levels = [stage(pairs.where("n = 0").select("context", "char", *[mixed(k, F.lit(1.0 / 256)) for k in ("allow", "block")]), "url-level").df]
    for n in range(1, max_order + 1):
        shorter = levels[-1].select(F.col("context").alias("suffix"), "char", F.col("p_allow").alias("s_allow"), F.col("p_block").alias("s_block"))
        longer = pairs.where(F.col("n") == n).withColumn("suffix", F.substring("context", 2, max_order))
        longer = longer.join(shorter, ["suffix", "char"]).select("context", "char", *[mixed(k, F.col(f"s_{k}")) for k in ("allow", "block")])
        levels.append(stage(longer, "url-level").df)
    ratios = reduce(DataFrame.unionByName, levels).select("context", "char", (F.log("p_allow") - F.log("p_block")).alias("ratio"))
    scores = spots.join(ratios, ["context", "char"]).groupBy("id").agg(F.sum("ratio").alias("total"))
    return stage(urls.join(scores, "id").select("url", "kind", (F.col("total") / (F.length("url") + 1)).alias("score")), "url-scores").df


def judge_urls(
    pages: DataFrame, *, url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, model: UrlModel | None = None,
    max_order: int = 5, min_context: int = 1,
) -> DataFrame:
    """Add ``host, path, rule, verdict string, lm_score double`` to every row.

    A null URL or one without ``://`` has empty host and path and fits no rule;
    a null or empty one scores 0.  Where no rule fits, the verdict is ``allow`` if
    the score is at or above the threshold.  Repeated rows are judged alike;
    clashing input columns are replaced.
    """
    rules = RULES if rules is None else rules
    url = F.col(url_col)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumns({"host": host_of(url), "path": path_of(url)}).withColumns({"rule": rule, "verdict": verdict})
    if model is None:
        scores = _scored_urls(ruled.select(url.alias("url"), F.col("verdict").alias("kind")), max_order, min_context)
        threshold = best_threshold(scores.where("kind IS NOT NULL").select("score", (F.col("kind") == "allow").alias("good")))
        scores = scores.select(F.col("url").alias("_url"), F.col("score").alias("lm_score"))
        scored = ruled.drop("lm_score").join(scores, url == F.col("_url"), "left").drop("_url").withColumn("lm_score", F.coalesce("lm_score", F.lit(0.0)))
        return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("lm_score") >= threshold, "allow").otherwise("block")))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        texts = batch.column(batch.schema.get_field_index(url_col)).to_pylist()
        return [pa.array([m.ratio(t) for t in texts], pa.float64())]

    scored = add_columns(ruled, [T.StructField("lm_score", T.DoubleType())], compute)
    by_model = F.when(F.col("lm_score") >= model.threshold, "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce("verdict", by_model))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.round("lm_score", 6).alias("lm_score"))


def _sql(order: int = 5) -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in by_length) + " END"
    kind = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in by_length) + " END"
    mixed = lambda k, shorter: f"CASE WHEN coalesce(t_{k}, 0) > 0 THEN (coalesce(c_{k}, 0) + u_{k} * {shorter}) / (t_{k} + u_{k}) ELSE {shorter} END AS p_{k}"
    levels = [f"l0 AS (SELECT context, char, {mixed('allow', '(1.0::DOUBLE / 256)')}, {mixed('block', '(1.0::DOUBLE / 256)')} FROM pc WHERE n = 0)"]
    for n in range(1, order + 1):
        levels.append(f"l{n} AS (SELECT pc.context, pc.char, {mixed('allow', 's.p_allow')}, {mixed('block', 's.p_block')} FROM pc JOIN l{n - 1} s ON s.context = substring(pc.context, 2) AND s.char = pc.char WHERE n = {n})")
    counts = ", ".join(f"CAST(sum(CASE WHEN kind = '{k}' THEN copies ELSE 0 END) AS DOUBLE) AS c_{k}" for k in ("allow", "block"))
    totals = ", ".join(f"sum(c_{k}) AS t_{k}, count(*) FILTER (c_{k} > 0) AS u_{k}" for k in ("allow", "block"))
    return f"""
WITH h AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {rule} AS rule, {kind} AS kind FROM h),
u AS (SELECT url, kind, chr(2) || url || chr(3) AS padded, count(*) AS copies FROM r WHERE url <> '' GROUP BY url, kind),
places AS (SELECT *, unnest(range(2, length(padded) + 1)) AS i FROM u), sp AS (SELECT *, unnest(range(0, least({order}, i - 1) + 1)) AS n FROM places),
x AS (SELECT url, kind, copies, i, n, substring(padded, i - n, n) AS context, substring(padded, i, 1) AS char FROM sp),
g AS (SELECT context, char, {counts} FROM x WHERE kind IS NOT NULL GROUP BY context, char), t AS (SELECT context, {totals} FROM g GROUP BY context),
pc AS (SELECT q.n, q.context, q.char, g.c_allow, g.c_block, t.t_allow, t.u_allow, t.t_block, t.u_block FROM (SELECT DISTINCT n, context, char FROM x) q LEFT JOIN t ON t.context = q.context LEFT JOIN g ON g.context = q.context AND g.char = q.char),
{", ".join(levels)}, l AS ({" UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(order + 1))}),
sc AS (SELECT x.url, any_value(x.kind) AS kind, sum(ln(p_allow) - ln(p_block)) / (length(x.url) + 1) AS score FROM x JOIN l ON l.context = x.context AND l.char = x.char WHERE n = least({order}, i - 1) GROUP BY x.url),
per AS (SELECT score, count(*) FILTER (kind = 'allow') AS good, count(*) FILTER (kind = 'block') AS bad FROM sc WHERE kind IS NOT NULL GROUP BY score),
run AS (SELECT score, sum(good) OVER w AS cg, sum(bad) OVER w AS cb, lead(score) OVER (ORDER BY score) AS following, sum(good) OVER () AS g, sum(bad) OVER () AS b FROM per WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
cost AS (SELECT round(1 + cg / g - cb / b, 12) AS cost, score, following FROM run WHERE g > 0 AND b > 0 AND following IS NOT NULL ORDER BY 1, 2 LIMIT 1),
th AS (SELECT CASE WHEN coalesce((SELECT sum(good) FROM per), 0) = 0 OR coalesce((SELECT sum(bad) FROM per), 0) = 0 THEN 0.0 WHEN (SELECT cost FROM cost) < 1 THEN (SELECT (score + following) / 2 FROM cost) ELSE (SELECT min(score) FROM per) END AS cut)
SELECT page_id, host, path, rule, coalesce(r.kind, CASE WHEN coalesce(score, 0.0) >= cut THEN 'allow' ELSE 'block' END) AS verdict, round(coalesce(score, 0.0), 6) AS lm_score
FROM r LEFT JOIN sc ON sc.url = r.url, th
"""


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE = {"op10_url_filter": _sql()}
