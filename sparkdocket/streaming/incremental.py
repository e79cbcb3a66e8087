"""New items as a stream, deduped against all that came before by two chained state stores.

The first operator keeps, for each message id, the item that came first and its
hash; the second keeps, for each logical hash, the first item that may stand for
it.  A micro-batch touches the state of its own keys only: nothing that came
earlier is read again.  State and output are committed together with the batch, so
a batch that fails in its midst runs again as if it had not begun.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from sparkdocket.functions import norm

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstOfKey(StatefulProcessor):
    """Adds ``<out>`` (the first item of the key) and ``<out>_hash`` (its hash) to the rows of a key.

    Rows whose key is theirs alone (``lone``) pass without state.  ``may`` says which rows can come first.
    """

    def __init__(self, kind: str, out: str, may) -> None:
        self.kind, self.out, self.may = kind, out, may

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", f"item_id {self.kind}, logical_hash string")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        held = sorted((r.asDict() for r in rows), key=lambda r: (r["path"] is not None, r["path"] or "", r["item_id"]))
        first = None
        if not held[0]["lone"]:
            known = self.first.get() if self.first.exists() else None
            if known is not None:
                first = (known[0], known[1])
            else:
                first = next(((r["item_id"], r["logical_hash"]) for r in held if self.may(r)), None)
                if first is not None:
                    self.first.update(first)
        for r in held:
            yield Row(**{k: v for k, v in r.items() if k not in ("key", "lone")}, **{self.out: first and first[0], f"{self.out}_hash": first and first[1]})


def _keyed(rows: DataFrame, key, prefix: str) -> DataFrame:
    """Rows with their key; those without one get a key of their own, so that they do not meet."""
    return rows.withColumn("lone", key.isNull()).withColumn("key", F.coalesce(F.concat(F.lit(prefix), key), F.concat(F.lit("item-"), F.col("item_id").cast("string"))))


def dedupe_roles(items: DataFrame) -> DataFrame:
    """Roles of a stream of items, as ``dedupe_items`` gives them: ``item_id, ..., dedup_role, dedup_tier, group_id, hash_conflict``.

    Of items of one micro-batch the first by path and id comes first; an item of an
    earlier batch always does, however late others arrive.  Items that take no part
    (attachments, those not extracted) are left out.  Ids are unique.
    """
    spark = items.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    kind = items.schema["item_id"].dataType.simpleString()
    base = f"item_id {kind}, path string, mid string, logical_hash string"
    now = items.where(F.col("status").isin(norm.ANALYZABLE) & (F.coalesce(F.col("role"), F.lit("parent")) != "attachment"))
    now = now.select("item_id", "path", norm.message_id(F.col("message_id")).alias("mid"), "logical_hash")

    def through(rows: DataFrame, processor: _FirstOfKey, schema: str) -> DataFrame:
        return rows.groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")

    by_mid = through(_keyed(now, F.col("mid"), "mid-"), _FirstOfKey(kind, "mid_first", lambda r: True), f"{base}, mid_first {kind}, mid_first_hash string")
    # Of items with a message id only the first one stands for its hash.
    stands = lambda r: r["mid"] is None or r["item_id"] == r["mid_first"]
    by_hash = through(_keyed(by_mid, F.col("logical_hash"), "hash-"), _FirstOfKey(kind, "hash_first", stands), f"{base}, mid_first {kind}, mid_first_hash string, hash_first {kind}, hash_first_hash string")
    has_mid = F.col("mid").isNotNull()
    group = F.when(has_mid, F.col("mid_first")).otherwise(F.coalesce("hash_first", "item_id"))
    tier = F.when(has_mid, "message_id").when(F.col("logical_hash").isNotNull(), "logical_hash").otherwise("none")
    conflict = has_mid & (F.col("item_id") != F.col("mid_first")) & F.coalesce(F.col("logical_hash") != F.col("mid_first_hash"), F.lit(False))
    return by_hash.select("item_id", "path", "mid", "logical_hash", F.when(group == F.col("item_id"), "unique").otherwise("duplicate").alias("dedup_role"), tier.alias("dedup_tier"), group.alias("group_id"), conflict.alias("hash_conflict"))


def dedupe_stream(items: DataFrame, store: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends the roles of ``items`` to ``store`` (Parquet)."""
    return dedupe_roles(items).writeStream.format("parquet").outputMode("append").option("path", store).option("checkpointLocation", checkpoint)
