"""Operator 11: exact duplicates by a distributed radix partitioning from the first byte on.

A round splits every open group by its documents' next bytes: rows are counted by (group, bytes) with partial sums in each
task, and the groups that two rows or more share go on to the next round with what is left of their texts. A group is done if one
row is left, or if its bytes have ended. The bytes of a round grow from 64 sixteenfold, so that five rounds reach 4 MB, and most documents
differ in the first. Rows learn their group by a join of stored tables, in which adaptive execution splits a hot group; the join is one by
sorting at every size, so that what is true of a small corpus is true of a large one. In the first round, rows whose bytes a bitmap
shows to be no group's don't go there at all. Equality is that of bytes, no digest is compared.
"""

from __future__ import annotations

import hashlib
import string
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, shared_folder, slices

FIRST, GROWTH, WIDEST = 64, 16, 1 << 30
BITS = 1 << 27


def normal(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def first_bytes(text: Column, width: int) -> Column:
    return F.substring(normal(F.left(text, F.lit(width))).cast("binary"), 1, width)


def may_share(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """`rows` with `near`: whether their first bytes may be those of a group. A bitmap of BITS bits of hashes, 16 MB at most, is broadcast; it only spares
    rows the way to the join, which compares bytes.
    """
    slot = F.pmod(F.xxhash64("digit"), F.lit(BITS))
    held = groups.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bit = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = rows.withColumn("slot", slot).join(F.broadcast(held), F.bitmap_bucket_number("slot") == F.col("bucket"), "left")
    return met.withColumn("near", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("slot", "bucket", "bits")


def with_rest(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(id, group, text) to (id, sha256, group, rest): the digest of the normal text and, in groups, its bytes behind the first ones."""
    for batch in slices(batches, "text"):
        data = pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.binary()).to_pylist()
        digest = pa.array([hashlib.sha256(x).hexdigest() for x in data])
        rest = pa.array([x[width:] if more else None for x, more in zip(data, pc.is_valid(batch.column("grp")).to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), digest, batch.column("grp"), rest], ["id", "sha", "grp", "rest"])


def partitioned(ids_and_texts: DataFrame) -> DataFrame:
    """(id, sha, keep_id, size, kept) of the rows of (id, text)."""
    spark = ids_and_texts.sparkSession
    folder = f"{shared_folder(spark)}/radix-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = ids_and_texts.withColumn("digit", first_bytes(F.col("text"), FIRST))
    groups = rows.groupBy("digit").agg(F.count("*").alias("size")).where("size > 1")
    groups = stored(groups.select("digit", F.monotonically_increasing_id().alias("grp")), "groups-0")
    id_type = ids_and_texts.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("sha", T.StringType()), T.StructField("grp", T.LongType()), T.StructField("rest", T.BinaryType())])
    rows = may_share(rows, groups)
    alone = rows.where("not near").select("id", F.lit(None).cast("long").alias("grp"), "text")
    met = alone.unionByName(rows.where("near").join(groups.hint("merge"), "digit", "left").select("id", "grp", "text"))
    met = met.mapInArrow(lambda batches: with_rest(batches, FIRST), schema)
    # the first round ends no group: rows have numbers only once they are stored
    level = stored(met.withColumn("row", F.monotonically_increasing_id()), "rows-0")
    parts = [level.where("grp is null").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"))]
    width, nth = FIRST, 0
    while level.where("grp is not null").limit(1).count():
        width, nth = min(width * GROWTH, WIDEST), nth + 1
        digit = F.substring("rest", 1, width)
        shared = level.where("grp is not null").select("id", "sha", "row", "grp", "rest")
        groups = shared.groupBy("grp", digit.alias("digit")).agg(F.count("*").alias("size"), F.max(F.struct("id", "row")).alias("top")).where("size > 1")
        groups = stored(groups.select(F.col("grp").alias("of"), "digit", "size", "top", F.monotonically_increasing_id().alias("next")), f"groups-{nth}")
        goes_on = F.length("digit") == width
        met = shared.join(groups.hint("merge"), (F.col("grp") == F.col("of")) & (digit == F.col("digit")), "left").select(
            "id", "sha", "row", F.when(goes_on, F.col("next")).alias("grp"), F.when(goes_on, F.substring("rest", F.lit(width + 1), F.length("rest"))).alias("rest"),
            F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("size"),
            (F.col("size").isNull() | (F.col("row") == F.col("top.row"))).alias("kept"),
        )
        level = stored(met, f"rows-{nth}")
        parts.append(level.where("grp is null").select("id", "sha", "keep_id", "size", "kept"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: its key, keep_id (the key of the row that stays of those with its text), group_size, kept and
    text_sha256. Texts are equal if they are once A-Z are in lower case; null counts as empty, and empty texts are a group like others. The row of the
    largest key stays; of repeated rows with that key one does, whichever is stored last. Null keys are smaller than others; a
    group of null keys alone keeps one of its rows, with a null keep_id. Other columns of `df` are not looked at and may have any name.
    """
    found = partitioned(df.select(named(key).alias("id"), named(text).alias("text")))
    return found.select(F.col("id").alias(key), F.col("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stay, with all columns. Of repeated rows with one key and text any one stays."""
    stay = partitioned(df.select(named(key).alias("id"), named(text).alias("text"))).where("kept").select("id", "sha")
    row = df.select(F.struct(*map(named, df.columns)).alias("row"), named(key).alias("own"), F.sha2(normal(named(text)).cast("binary"), 256).alias("digest"))
    met = row.join(stay, F.col("own").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha")), "left_semi").dropDuplicates(["own", "digest"])
    return met.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
