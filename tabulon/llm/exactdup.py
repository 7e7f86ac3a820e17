"""Exact deduplication by stateful streaming, with DataFrame operations only.

The stream folds each document into a keyed state that never expires: digest of the
normalised text, the largest id seen, a locator of that row's content, and a count. The
state lives on disk in RocksDB and in the checkpoint folder, so a run goes on where it
stopped and later files meet all earlier ones. Equal digests are only a claim: every hit
is settled by comparing full texts with the row that the locator names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulon.llm.common import col, cut, lower_ascii, shared_folder

PARTNERS = 256  # hits that one copy of the content they are compared with serves
BROADCAST_GROUPS = 200_000  # groups of copies counted to be no more may be broadcast
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store takes some MB of disk when empty
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normal(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def digest(text: Column, bits: int = 256) -> Column:
    """sha256 of a normalised text, cut to `bits` bits."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, bits // 8)


@dataclass
class StreamingDedup:
    """The keyed state in `checkpoint`, fed by a Parquet folder or file that only grows.

    `bits` shortens the digest, for tests of what happens when different texts share one.
    """

    spark: SparkSession
    source: str
    checkpoint: str
    id_col: str = "doc_id"
    text_col: str = "text"
    bits: int = 256
    files_per_batch: int = 10_000

    def update(self) -> None:
        """Fold all files that are new into the state; ends when none is left."""
        spark = self.spark.newSession()
        for key, value in ROCKSDB.items():
            spark.conf.set(key, value)
        # A new session has its own settings; the state's partitions are those of the caller's shuffles.
        spark.conf.set("spark.sql.shuffle.partitions", self.spark.conf.get("spark.sql.shuffle.partitions"))
        schema = self.spark.read.parquet(self.source).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch)
        # A pattern that matches this path alone: only then may it be a single file too.
        path = self.source.rstrip("/")
        stream = stream.parquet(f"{path[:-1]}[{path[-1]}]")
        locator = F.struct(col(self.id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        rows = stream.select(digest(normal(col(self.text_col)), self.bits).alias("digest"), locator.alias("at"))
        state = rows.groupBy("digest").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))
        query = (
            state.writeStream.format("noop").outputMode("update").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def state(self) -> DataFrame:
        """(digest, id, file, row, n): what the state holds after the last batch."""
        stored = self.spark.read.format("statestore").load(self.checkpoint)
        value = [F.col("value")[f.name] for f in stored.schema["value"].dataType.fields]
        at, n = value[0], value[1]
        return stored.select(F.col("key.digest").alias("digest"), at["id"].alias("id"), at["file"].alias("file"), at["row"].alias("row"), n.alias("n"))

    def rows(self) -> DataFrame:
        """(id, file, row, text, digest) of all content, texts normalised."""
        text = normal(col(self.text_col))
        read = self.spark.read.parquet(self.source)
        return read.select(
            col(self.id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text.alias("text")
        ).withColumn("digest", digest(F.col("text"), self.bits))

    def decisions(self) -> DataFrame:
        """One row (id, keep_id, group_size, kept, text_sha256) for each row of the source."""
        groups = cut(self.state().where("n > 1").select("digest", F.col("id").alias("keep"), "file", "row", "n"), "groups")
        n_groups = groups.count()
        few = F.broadcast if n_groups <= BROADCAST_GROUPS else (lambda df: df)
        rows, parts = self.rows(), F.floor((F.col("n") - 1) / PARTNERS) + 1
        # The content of the rows that the locators name, once for every PARTNERS hits of a group, so that a
        # large group is spread over many tasks.
        heads = rows.join(few(groups.select("file", "row", "n")), ["file", "row"]).select(
            "digest", F.col("text").alias("content"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part")
        )
        hits = rows.join(few(groups.select("digest", "keep", "n", F.col("file").alias("keep_file"), F.col("row").alias("keep_row"))), "digest")
        hits = hits.where((F.col("file") != F.col("keep_file")) | (F.col("row") != F.col("keep_row")))
        # A place among the copies that is as good as even, whatever the group's size.
        compared = hits.withColumn("part", F.pmod(F.xxhash64("file", "row"), parts)).join(heads, ["digest", "part"])
        other = F.when(F.col("text") != F.col("content"), F.col("text"))
        unequal = cut(compared.select("digest", "id", other.alias("text")).where(F.col("text").isNotNull()), "unequal")
        sha = F.lower(F.hex("digest")) if self.bits == 256 else F.sha2("text", 256)
        found = rows.select("id", "digest", sha.alias("text_sha256"), *([] if self.bits == 256 else ["text"]))
        if unequal.isEmpty():  # equal digests were equal texts throughout
            out = found.join(few(groups.select("digest", "keep", "n")), "digest", "left")
            return self._told(out, F.coalesce("n", F.lit(1)), F.coalesce("keep", "id"))
        return self._apart(rows, groups, unequal)

    def _apart(self, rows: DataFrame, groups: DataFrame, unequal: DataFrame) -> DataFrame:
        """The decisions where some digests stand for several texts: there, texts are the keys."""
        mixed = unequal.select("digest").distinct()
        exact = rows.join(mixed, "digest").groupBy("digest", "text").agg(F.max("id").alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
        out = rows.withColumn("text_sha256", F.sha2("text", 256)).join(groups.select("digest", "keep", "n"), "digest", "left")
        out = out.join(exact, ["digest", "text"], "left")
        return self._told(out, F.coalesce("own_n", "n", F.lit(1)), F.coalesce("own_keep", "keep", "id"))

    @staticmethod
    def _told(out: DataFrame, size: Column, keep: Column) -> DataFrame:
        return out.select(
            "id", keep.alias("keep_id"), size.cast("bigint").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256"
        )


def deduplicate(spark: SparkSession, source: str, id_col: str = "doc_id", text_col: str = "text", bits: int = 256) -> DataFrame:
    """One row (id, keep_id, group_size, kept, text_sha256) for each row of the Parquet
    folder or file `source`. Texts are equal when they are after lower-casing A-Z; of equal
    texts the row with the largest id stays.

    A null text is an empty text. Rows that repeat an id and a text are all kept or all
    dropped, as the id says. A null id is smaller than any other: it stays only among
    null ids. Other columns are not looked at.
    """
    dedup = StreamingDedup(spark, source, shared_folder(spark, "dedup"), id_col, text_col, bits)
    dedup.update()
    return dedup.decisions()
