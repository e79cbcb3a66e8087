"""Text analytics: entities, file kinds, chunks, term weights, search, tone, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdocket.functions import norm

# Bits of the entity packs.
ENTITY_BITS = {"email": 1, "phone": 2, "ssn": 4, "card": 8, "currency": 16}
# Portable patterns: no look-around, so that they mean the same in every engine.
ENTITY_PATTERNS = {
    "email": "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+){0,126}[.][A-Za-z]{2,24}",
    "phone": "[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}|[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": "[0-9]{13,19}",
    "currency": "[$] ?[0-9]{1,3}(?:,[0-9]{3}){0,12}(?:[.][0-9]{2})?",
}


def luhn_ok(digits: Column) -> Column:
    """The check digit fits: every second digit from the right is doubled."""
    value = lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int"))
    return F.pmod(F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x), F.lit(10)) == 0


def _valid(kind: str):
    def check(x: Column) -> Column:
        if kind == "card":
            return x.rlike("^[2-6]") & luhn_ok(x)
        if kind == "ssn":
            return ~x.rlike("^(000|666|9..)-|-00-|-0000$")
        return F.lit(True)

    return check


def entity_hits(df: DataFrame, id_col: str, text_col: str, packs: list[str] | None = None) -> DataFrame:
    """One row per valid match: ``id, entity_type, value, masked, match_hash``."""
    found = [
        F.filter(F.regexp_extract_all(F.col(text_col), F.lit(f"({ENTITY_PATTERNS[p]})"), F.lit(1)), _valid(p)).alias(p)
        for p in (packs or list(ENTITY_PATTERNS))
    ]
    wide = df.select(F.col(id_col).alias("id"), *found)
    kinds = F.array(*[F.struct(F.lit(p).alias("entity_type"), F.col(p).alias("vals")) for p in (packs or list(ENTITY_PATTERNS))])
    rows = wide.select("id", F.explode(kinds).alias("k")).select("id", "k.entity_type", F.explode("k.vals").alias("value"))
    normal = F.when(F.col("entity_type") == "email", F.lower("value")).otherwise(F.regexp_replace("value", "[^0-9.]", ""))
    masked = F.when(F.col("entity_type") == "email", norm.mask_email(F.col("value"))).when(F.col("entity_type") == "currency", F.lit("$***")).otherwise(norm.mask_tail(F.col("value")))
    return rows.select("id", "entity_type", "value", masked.alias("masked"), F.sha2(normal, 256).alias("match_hash"))


def entity_flags(hits: DataFrame) -> DataFrame:
    """Flags and number of hits of each item."""
    bit = reduce(lambda acc, kv: F.when(F.col("entity_type") == kv[0], kv[1]).otherwise(acc), ENTITY_BITS.items(), F.lit(0))
    return hits.groupBy("id").agg(F.bit_or(bit).cast("long").alias("flags"), F.count(F.lit(1)).alias("n_hits"))


# Kinds by extension and by MIME prefix.
_EXTENSIONS = {
    "email": ["eml", "msg"], "document": ["doc", "docx", "odt", "rtf", "txt"], "spreadsheet": ["xls", "xlsx", "csv"], "presentation": ["ppt", "pptx"], "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "gif", "tif"], "web": ["html", "htm"], "archive": ["zip", "7z", "gz", "tar"], "calendar": ["ics"], "audio": ["mp3", "wav"], "video": ["mp4", "mov"],
}
_MAGIC = {"25504446": "pdf", "504B0304": "archive", "89504E47": "image", "FFD8FF": "image", "47494638": "image", "D0CF11E0": "document", "1F8B": "archive"}
_MIME = {"application/pdf": "pdf", "image/": "image", "audio/": "audio", "video/": "video", "text/html": "web", "text/calendar": "calendar", "message/": "email", "application/zip": "archive", "text/": "document"}


def classify_file(path: Column, mime: Column, head: Column, message_class: Column | None = None) -> Column:
    """Struct ``category, method``: message class, leading bytes, MIME, extension, in this order.

    A container's bytes yield to an extension that names a kind kept in such containers.
    """
    ext = F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]{1,8})$", 1))
    by_ext = reduce(lambda acc, kv: F.when(ext.isin(kv[1]), kv[0]).otherwise(acc), _EXTENSIONS.items(), F.lit(None).cast("string"))
    start = F.hex(F.substring(head, 1, 8))
    by_magic = reduce(lambda acc, kv: F.when(start.startswith(kv[0]), kv[1]).otherwise(acc), _MAGIC.items(), F.lit(None).cast("string"))
    by_magic = F.when(by_magic.isin("archive", "document") & by_ext.isin("document", "spreadsheet", "presentation"), by_ext).otherwise(by_magic)
    by_mime = reduce(lambda acc, kv: F.when(F.lower(mime).startswith(kv[0]), kv[1]).otherwise(acc), reversed(_MIME.items()), F.lit(None).cast("string"))
    by_class = F.when(F.lower(message_class).startswith("ipm.note"), "email").when(F.lower(message_class).startswith("ipm.appointment"), "calendar") if message_class is not None else F.lit(None).cast("string")
    signal = (F.coalesce(path, F.lit("")) != "") | mime.isNotNull()
    category = F.coalesce(by_class, by_magic, by_mime, by_ext, F.when(signal, "other").otherwise("unrecognized"))
    method = F.when(by_class.isNotNull(), "message_class").when(by_magic.isNotNull(), "magic").when(by_mime.isNotNull(), "mime").when(by_ext.isNotNull(), "extension").otherwise("none")
    return F.struct(category.alias("category"), method.alias("method"))


def chunk_text(df: DataFrame, id_col: str, text_col: str, size: int = 800, overlap: int = 120, most: int | None = None) -> DataFrame:
    """Overlapping chunks by characters: ``id, ordinal, start, end, chunk, dropped`` (chunks beyond ``most``; None: no limit)."""
    n, step = F.length(text_col), size - overlap
    count = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - overlap) / step))).cast("int")
    base = df.where(F.col(text_col).isNotNull() & (n > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), count.alias("chunks"))
    kept = F.col("chunks") if most is None else F.least(F.col("chunks"), F.lit(most))
    rows = base.select("*", F.explode(F.sequence(F.lit(0), kept - 1)).alias("ordinal")).withColumn("start", F.col("ordinal") * step)
    return rows.select("id", "ordinal", "start", F.least(F.col("start") + size, F.length("t")).alias("end"), F.substring("t", F.col("start") + 1, F.lit(size)).alias("chunk"), (F.col("chunks") - kept).alias("dropped"))


def tokens(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Lower-case runs of letters and digits, two or more long and not only digits, one row each."""
    found = F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9ß-ÿ]{2,})"), F.lit(1))
    return df.select(*keys, F.explode(F.filter(found, lambda w: ~w.rlike("^[0-9]+$"))).alias("term"))


def tf_idf(toks: DataFrame, key: str, min_df: int = 2, max_share: float = 0.9) -> DataFrame:
    """Unit-length term weights (1 + ln tf) * ln(1 + N / (1 + df)) of terms with a fit document frequency."""
    tf = toks.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = toks.select(key).distinct().count()
    most = max(1, int(max_share * n))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= most))
    w = tf.join(df, "term").select(key, "term", ((1 + F.log("tf")) * F.log(1 + F.lit(n) / (1 + F.col("df")))).alias("w"))
    length = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(length, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def group_labels(toks: DataFrame, group: str, top: int = 8) -> DataFrame:
    """The terms that set each group apart, by (1 + ln tf) * ln(1 + K / df), ties by term."""
    tf = toks.groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf"))
    k = tf.select(group).distinct().count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, "term").withColumn("score", F.round((1 + F.log("tf")) * F.log(1 + F.lit(k) / F.col("df")), 9))
    w = Window.partitionBy(group).orderBy(F.desc("score"), "term")  # Spark keeps only the first rows of each group per task
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(group, "rank", "term", "score")


def bm25(toks: DataFrame, key: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Relevance of documents that hold every query term (``key, score``)."""
    lengths = toks.groupBy(key).agg(F.count(F.lit(1)).alias("len"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    wanted = sorted(set(query))
    tf = toks.where(F.col("term").isin(wanted)).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats["mean"] or 1.0)))
    scored = tf.join(df, "term").join(lengths, key).groupBy(key).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("terms"))
    return scored.where(F.col("terms") == len(wanted)).select(key, F.round("score", 6).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def semantic_search(chunks: DataFrame, query_vector: list[float], item: str, vector: str, eligible: DataFrame | None = None, min_score: float = -1.0) -> DataFrame:
    """Best chunk score of each eligible item (``item, score``); items are cut down before scoring."""
    base = chunks if eligible is None else chunks.join(eligible.select(item).distinct(), item, "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    return base.select(item, cosine(F.col(vector), q).alias("s")).groupBy(item).agg(F.round(F.max("s"), 6).alias("score")).where(F.col("score") >= min_score)


def tone_of_units(units: DataFrame, key: str, score: str, position: str, strong: float = 0.05) -> DataFrame:
    """Item tone from unit scores: the unit of largest absolute score (the first of equals), extremes, polarity."""
    best = F.max(F.struct(F.abs(score).alias("a"), (-F.col(position)).alias("p"), F.col(score).alias("s")))["s"]
    polarity = F.when(F.col("compound") >= strong, "positive").when(F.col("compound") <= -strong, "negative").otherwise("neutral")
    return units.where(F.col(score).isNotNull()).groupBy(key).agg(best.alias("compound"), F.min(score).alias("low"), F.max(score).alias("high")).withColumn("polarity", polarity)


def merge_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Union of [start, end) ranges per key; touching ones merge."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.where("end > start").select(key, "start", "end").distinct().withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(key, "start", "end")


def redact(texts: DataFrame, merged: DataFrame, key: str, text_col: str, token: str = "[REDACTED]") -> DataFrame:
    """Texts with each merged range, clamped to the text, replaced by one token."""
    spans = merged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    n = F.length(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        a, z = F.least(s["start"].cast("long"), n.cast("long")), F.least(s["end"].cast("long"), n.cast("long"))
        gap = F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (a - acc["at"]).cast("int"))
        return F.when(z > a, F.struct(F.concat(acc["out"], gap, F.lit(token)).alias("out"), z.alias("at"))).otherwise(acc)

    built = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), n)))
    return texts.join(spans, key, "left").select(key, F.when(F.col("spans").isNull(), F.col(text_col)).otherwise(built).alias("redacted"))


def quote_occurrences(text: Column, quote: Column) -> Column:
    """How often a quotation occurs, case and white space aside; a citation stands if it is exactly one."""
    t, q = F.lower(norm.collapse(text)), F.lower(norm.collapse(quote))
    return F.when(F.length(q) > 0, ((F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)).cast("int")).otherwise(0)


def dat_line(fields: list[Column]) -> Column:
    """One Concordance line: þ around each field, ¶ between, line ends inside as ®."""
    clean = [F.concat(F.lit("þ"), F.regexp_replace(F.replace(F.coalesce(f.cast("string"), F.lit("")), F.lit("þ"), F.lit("")), "\r\n|\r|\n", "®"), F.lit("þ")) for f in fields]
    return F.concat_ws("¶", *clean)

