"""Structured Streaming jobs: the feed, plans from toggles, and the live board."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import feed
from tessera.sources.shared import scratch
from tessera.streaming import state


def file_stream(spark: SparkSession, path: str, per_batch: int = 8) -> DataFrame:
    """A stream of a folder's Parquet files as they come; a single file is a stream of one."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, which may name a file


#: Where keyed state lives while a stream runs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in a store with maps and timers."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def drained(stream: DataFrame, label: str, mode: str = "append", each=None, state: str | None = None) -> str:
    """Runs a stream over all that is there, with its checkpoint in the shared folder or in ``state``; returns the sink's folder."""
    spark = stream.sparkSession
    to = scratch(spark, label)
    writer = stream.writeStream.option("checkpointLocation", state or scratch(spark, f"{label}-state")).outputMode(mode).trigger(availableNow=True)
    if each is None:
        query = writer.format("parquet").option("path", to).start()
    else:
        query = writer.foreachBatch(lambda batch, n: each(batch, n, to)).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    return to


def upsert(batch: DataFrame, n: int, to: str) -> None:
    """A batch of changes under its number: a batch that runs again replaces what it wrote."""
    batch.write.mode("overwrite").parquet(f"{to}/batch={n}")


def titles_stream(items: DataFrame, known: DataFrame, days: int) -> DataFrame:
    """items (id, url, title, label, tags, t): changes of the stories by title. A story's time is its event time, and the watermark
    lies ``days`` behind the newest, so that what is too old to come is too old to stay."""
    rows = items.withColumns({"title_key": feed.title_key(F.col("title")), "key": feed.canonical_url(F.col("url")), "at": F.timestamp_seconds("t")})
    rows = rows.filter(feed.is_story(F.col("title")) & F.col("label").isNotNull() & (F.size("tags") > 0)).withWatermark("at", f"{days * 86400 + 1} seconds")
    rows = rows.join(known.select(feed.title_key(F.col("title")).alias("title_key")).distinct(), "title_key", "left_anti")
    rows = rows.select("title_key", "id", "label", "key", "t", F.array_join("tags", ",").alias("tags"), "at")
    return rows.groupBy("title_key").transformWithStateInPandas(state.Title(), state.STORY, "Append", "EventTime")


def labels_stream(stories: DataFrame, per_label: int, parts: int) -> DataFrame:
    """Changes of the newest stories of each label and part of it."""
    rows = stories.withColumn("part", F.pmod(F.xxhash64("title_key"), F.lit(parts)).cast("int"))
    return rows.groupBy("label", "part").transformWithStateInPandas(state.Label(per_label), state.SHOWN, "Update", "None")


def feed_stream(items: DataFrame, known: DataFrame, days: int = 120, per_label: int = 25, parts: int = 8) -> DataFrame:
    """What ``feed.current_feed`` says of all items up to now, kept batch by batch: stories by title, then the newest by label.

    The first stream writes changes of stories as files; the second reads these as they come. Its sink takes upserts, of which the
    last of each story counts; at most ``parts`` times ``per_label`` are shown of a label, and the newest of these are the feed."""
    spark = items.sparkSession
    with keyed_state(spark):
        changes = drained(titles_stream(items, known, days), "stories")
        shown = drained(labels_stream(spark.readStream.schema(state.STORY).parquet(changes), per_label, parts), "feed", "update", upsert)
    rows = spark.read.schema(f"{state.SHOWN}, batch int").parquet(shown)
    last = rows.groupBy("label", "part", "title_key").agg(F.max_by(F.struct("id", "key", "t", "tags", "shown"), F.struct("version", "batch")).alias("x")).select("label", "title_key", "x.*")
    return feed.newest_of(last.filter("shown").drop("shown"), per_label).select("title_key", "id", "label", "key", "t", "tags")


def plan_stream(toggles: DataFrame, lateness: str) -> DataFrame:
    """toggles (user_id, item, action, seq, at), at in seconds and rising with seq: the current plan of each user whom a batch
    touches. Toggles more than ``lateness`` older than the newest one are left out; dropped items are forgotten after it."""
    rows = toggles.withColumn("time", F.timestamp_seconds("at")).withWatermark("time", lateness)
    return rows.groupBy("user_id").transformWithStateInPandas(state.Plan(), state.PLAN, "Update", "EventTime")


def latest_plans(toggles: DataFrame, lateness: str = "36500 days") -> DataFrame:
    """(user_id, item) after all that the stream has to say, in whatever order it comes."""
    spark = toggles.sparkSession
    with keyed_state(spark):
        to = drained(plan_stream(toggles, lateness), "plans", "update", upsert)
    rows = spark.read.schema(f"{state.PLAN}, batch int").parquet(to).groupBy("user_id").agg(F.max_by("items", "version").alias("items"))
    return rows.select("user_id", F.explode(F.transform(F.filter(F.split("items", ","), lambda x: x != ""), lambda x: x.cast("long"))).alias("item"))


def board_stream(ticks: DataFrame, instances: DataFrame) -> DataFrame:
    """Status changes of static instances over a stream of ticks. A batch is compared with the last tick of the batches before
    it, which each leaves beside its changes; both are written under the batch's number, so that a batch that runs again
    replaces what it wrote."""
    spark = ticks.sparkSession
    seen = scratch(spark, "board-ticks")

    def keep(batch: DataFrame, n: int, to: str) -> None:
        batch = batch.select("tick")
        earlier = spark.read.schema("tick long, batch int").parquet(seen).filter(F.col("batch") < n).agg(F.max("tick").alias("t")).first().t if n else None
        fresh = batch.filter(F.col("tick") > earlier) if earlier is not None else batch
        feed.status_changes(instances, fresh, earlier).write.mode("overwrite").parquet(f"{to}/batch={n}")
        last = batch.agg(F.greatest(F.max("tick"), F.lit(earlier)).alias("tick"))
        last.write.mode("overwrite").parquet(f"{seen}/batch={n}")

    to = drained(ticks, "board", "append", keep)
    return spark.read.schema("tick long, id long, status string, batch int").parquet(to).drop("batch")
