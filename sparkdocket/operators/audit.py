"""Hash-chained audit events: verification needs only each event's predecessor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def entry_hash(prev, *fields):
    """Digest of the previous digest and an event's fields."""
    return F.sha2(F.concat_ws("\n", F.coalesce(prev, F.lit("")), *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def verify_chain(events: DataFrame, fields: list[str]) -> DataFrame:
    """``seq, link_ok, hash_ok`` of each event.

    Event ``seq`` must name the digest of event ``seq - 1`` (none for the first)
    and carry the digest of that and its own fields.  The predecessor comes by a
    join on the number, not by a window over all events.
    """
    before = events.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("before"))
    joined = events.join(before, "seq", "left")
    return joined.select("seq", F.col("prev_hash").eqNullSafe(F.col("before")).alias("link_ok"), (F.col("entry_hash") == entry_hash(F.col("prev_hash"), *[F.col(f) for f in fields])).alias("hash_ok"))


def append_events(events: DataFrame, heads: DataFrame | None, chain: str, order: str, fields: list[str]) -> DataFrame:
    """New events of many chains with ``seq, prev_hash, entry_hash``, which go on from the chains' heads.

    ``heads`` has ``chain, seq, entry_hash``, the last event of each chain so far (none: all
    begin).  ``fields`` are hashed as text.  The events of a chain come in ``order`` (unique in
    it) to one task, which reads them as a sorted stream and holds one digest: each
    depends on the one before.
    """
    texts = [f"_f{n}" for n in range(len(fields))]
    rows = events.withColumns({t: F.coalesce(F.col(f).cast("string"), F.lit("")) for t, f in zip(texts, fields, strict=True)})
    if heads is None:
        rows = rows.withColumns({"_seq": F.lit(0).cast("long"), "_head": F.lit(None).cast("string")})
    else:
        # Heads are few beside events; a hot chain's events stay where they are if Spark broadcasts or splits.
        rows = rows.join(heads.select(chain, F.col("seq").cast("long").alias("_seq"), F.col("entry_hash").alias("_head")), chain, "left").withColumn("_seq", F.coalesce("_seq", F.lit(0).cast("long")))
    # By a hash, not by the chain itself: Spark leaves out a repartition that the join's own would meet, and may then broadcast the heads instead.
    sorted_rows = rows.repartition(F.xxhash64(chain)).sortWithinPartitions(chain, order)
    out = T.StructType([*events.schema.fields, T.StructField("seq", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    own = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, last = object(), 0, None
        for b in batches:
            column = lambda c, b=b: b.column(b.schema.get_field_index(c)).to_pylist()
            seqs, befores, digests = [], [], []
            for name, start, head, *parts in zip(column(chain), column("_seq"), column("_head"), *[column(t) for t in texts], strict=True):
                if name != now:
                    now, seq, last = name, start, head
                seq += 1
                befores.append(last)
                last = hashlib.sha256("\n".join([last or "", *parts]).encode()).hexdigest()
                seqs.append(seq)
                digests.append(last)
            kept = [b.column(b.schema.get_field_index(c)) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seqs, pa.int64()), pa.array(befores, pa.string()), pa.array(digests, pa.string())], names=[*own, "seq", "prev_hash", "entry_hash"])

    return sorted_rows.mapInArrow(run, out)


def chain_heads(events: DataFrame, chain: str) -> DataFrame:
    """``chain, seq, entry_hash`` of each chain's last event."""
    return events.groupBy(chain).agg(F.max(F.struct("seq", "entry_hash")).alias("h")).select(chain, "h.seq", "h.entry_hash")


def verify_chains(events: DataFrame, chain: str, fields: list[str]) -> DataFrame:
    """``chain, seq, link_ok, hash_ok`` of each event of many chains."""
    before = events.select(chain, (F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("before"))
    joined = events.join(before, [chain, "seq"], "left")
    good = F.col("entry_hash") == entry_hash(F.col("prev_hash"), *[F.col(f) for f in fields])
    return joined.select(chain, "seq", (F.col("prev_hash").eqNullSafe(F.col("before")) & (F.col("before").isNotNull() | (F.col("seq") == 1))).alias("link_ok"), good.alias("hash_ok"))


def selection_fingerprint(ids: DataFrame, key: str, pack: str = "") -> DataFrame:
    """One row ``items, root``: a digest of a set of ids and a rule pack, whatever their order and repeats.

    A tree of digests: ids fall into 65,536 leaves by the first four digits of their own
    digest, each leaf hashes its ids in order, 256 nodes hash their leaves and the root the
    nodes.  So no task reads more than a leaf's ids or 256 digests.
    """
    text = F.col(key).cast("string")
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    leaves = ids.select(text.alias("id")).where("id IS NOT NULL").distinct().withColumn("leaf", F.substring(F.sha2("id", 256), 1, 4))
    leaves = leaves.groupBy("leaf").agg(joined("id").alias("digest"), F.count(F.lit(1)).alias("n"))
    nodes = leaves.groupBy(F.substring("leaf", 1, 2).alias("node")).agg(joined(F.concat("leaf", F.lit(":"), "digest")).alias("digest"), F.sum("n").alias("n"))
    top = nodes.agg(F.array_join(F.array_sort(F.collect_list(F.concat("node", F.lit(":"), "digest"))), "\n").alias("all"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("items"))
    return top.select("items", F.sha2(F.concat("all", F.lit(f"\n#pack={pack.strip()}" if pack.strip() else "")), 256).alias("root"))
