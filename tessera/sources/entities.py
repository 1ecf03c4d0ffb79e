"""Reading entity files with fixed schemas, and publishing tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.records import numbered
from tessera.sources.shared import scratch


def read_entities(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under a fixed schema; a line that isn't such an object keeps its text in ``_corrupt_record``."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def load_entities(spark: SparkSession, root: str, schemas: dict[str, T.StructType], required: tuple[str, ...] = (), key: str = "id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by kind, problems) of the JSON lines in root/kind, whatever the number of files.

    A kind without a file gives an empty table. The problems (kind, id, level, message) tell of kinds that are required and missing
    or empty, of lines that are no such object (their text is the id) and of keys that several rows of a kind have."""
    tables, problems = {}, None
    for kind, schema in schemas.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        rows = spark.createDataFrame([], whole)
        if there:
            # parsed once: data and problems read the same table
            to = scratch(spark, f"entities-{kind}")
            read_entities(spark, f"{root}/{kind}", schema).write.parquet(to)
            rows = spark.read.schema(whole).parquet(to)
        sound = rows.filter("_corrupt_record is null")
        tables[kind] = sound.drop("_corrupt_record")
        told = lambda df, text, message, name=kind: df.select(F.lit(name).alias("kind"), text.cast("string").alias("id"), F.lit("error").alias("level"), F.lit(message).alias("message"))
        found = told(rows.filter("_corrupt_record is not null"), F.col("_corrupt_record"), "is no such object").unionByName(told(sound.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), F.col(key), "key twice"))
        if kind in required:
            none = spark.range(1).join(rows.limit(1), F.lit(True), "left_anti")
            found = found.unionByName(told(none, F.lit(None), "is empty" if there else "is missing"))
        problems = found if problems is None else problems.unionByName(found)
    return tables, problems


@dataclass(frozen=True)
class Kind:
    """Records of one kind: their schema, and the files that hold them as whole JSON arrays under a root. ``files`` is a glob below
    the root; what ``slice_in`` captures in a file's path is its slice."""

    name: str
    schema: T.StructType
    files: str
    slice_in: str
    required: bool = False


def load_slices(spark: SparkSession, root: str, kinds: list[Kind], slices: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(records by kind, problems): every slice of every kind under a root.

    A record has the columns of its schema, its slice and its place in the file (pos); what doesn't fit the schema is null. The
    problems (kind, slice, pos, level, message) say which files are missing (of the slices (slice) that should be there, or of the
    kind as a whole), empty, no JSON, no array, hold something else than objects, or values that don't fit. Only what is missing
    or empty without being required is a mere warning; a file without a byte is as good as missing. A file is read whole by one task; the files are found by listing."""
    found, problems = {}, None
    where, message = ["kind", "slice", "pos", "level", "message"], lambda what, level="error": (F.lit(level).alias("level"), F.lit(what).alias("message"))
    for kind in kinds:
        level = "error" if kind.required else "warning"
        files = _texts(spark, f"{root}/{kind.files}")
        whole = files.select(F.lit(kind.name).alias("kind"), F.regexp_extract("path", kind.slice_in, 1).alias("slice"), F.trim("value").alias("value"))
        whole = whole.withColumns({"items": F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")), "parses": F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>").isNotNull() & (F.col("value") != "")})
        whole = whole.withColumn("items", F.when(F.col("parses"), F.col("items")))
        to = scratch(spark, f"slices-{kind.name}")
        whole.select("kind", "slice", F.when(~F.col("parses"), "invalid JSON").when(F.col("items").isNull(), "must be an array").when(F.size("items") == 0, "is empty").alias("wrong"), F.posexplode_outer("items").alias("pos", "item")).write.parquet(to)
        rows = spark.read.parquet(to)
        sound = rows.filter("wrong is null")
        is_object = F.coalesce(F.startswith("item", F.lit("{")), F.lit(False))
        corrupt = T.StructType([*kind.schema.fields, T.StructField("_corrupt", T.StringType())])
        parsed = sound.filter(is_object).withColumn("x", F.from_json("item", corrupt, {"columnNameOfCorruptRecord": "_corrupt"}))
        found[kind.name] = parsed.select("slice", "pos", *(F.col("x")[f.name].alias(f.name) for f in kind.schema.fields))
        at_file = rows.filter("wrong is not null").select("kind", "slice", F.lit(None).cast("int").alias("pos"), F.when(F.col("wrong") == "is empty", level).otherwise("error").alias("level"), F.col("wrong").alias("message"))
        no_object = sound.filter(~is_object).select("kind", "slice", "pos", *message("must be an object"))
        misfit = parsed.filter(F.col("x._corrupt").isNotNull()).select("kind", "slice", "pos", *message("holds a value of the wrong type"))
        here = rows.select("slice").distinct()
        if slices is not None:
            gone = slices.select(F.col("slice").cast("string").alias("slice")).distinct().join(here, "slice", "left_anti")
        else:
            gone = spark.range(1).select(F.lit("").alias("slice")).join(here.limit(1).select(F.lit("").alias("slice")), "slice", "left_anti")
        gone = gone.select(F.lit(kind.name).alias("kind"), "slice", F.lit(None).cast("int").alias("pos"), *message("is missing", level))
        for one in (at_file, no_object, misfit, gone):
            problems = one.select(where) if problems is None else problems.unionByName(one.select(where))
    return found, problems


def _texts(spark: SparkSession, glob: str) -> DataFrame:
    """(path, value) of all files that a glob names, none if it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not there:
        return spark.createDataFrame([], "path string, value string")
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def publish_if_clean(df: DataFrame, problems: DataFrame, to: str) -> bool:
    """Stages df beside its place and puts it there only if there is no error; else the old output stays untouched, as it
    does where a rename fails, which raises."""
    if problems.filter("level = 'error'").limit(1).count():
        return False
    staged = f"{to}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(to)
    fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    old, fresh = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{to}.old-{uuid.uuid4().hex}", staged))
    replaced = fs.exists(path)
    if replaced and not fs.rename(path, old):
        fs.delete(fresh, True)
        raise OSError(f"{to} could not be moved away; it stays as it was")
    if not fs.rename(fresh, path):
        if replaced and not fs.rename(old, path):
            raise OSError(f"{to} could not be replaced; its old content is in {old}")
        fs.delete(fresh, True)
        raise OSError(f"{to} could not be replaced; it stays as it was")
    if replaced:
        fs.delete(old, True)
    return True


def stamp(s: Column) -> Column:
    """20240115T193000 from seconds, whatever the session's zone."""
    return F.date_format(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)")), "yyyyMMdd'T'HHmmss")


def calendar_feed(df: DataFrame) -> DataFrame:
    """One calendar text for each user: a block for every session in order, whole days as dates, cancelled ones marked."""
    whole = F.col("ad") | F.col("tu")
    block = F.concat_ws("\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "id"), F.concat(F.lit("SUMMARY:"), "title"), F.when(whole, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.substring(stamp(F.col("s")), 1, 8))).otherwise(F.concat(F.lit("DTSTART:"), stamp(F.col("s")))), F.when(~whole & ~F.col("eu"), F.concat(F.lit("DTEND:"), stamp(F.col("e")))), F.when(F.col("cancelled"), "STATUS:CANCELLED"), F.lit("END:VEVENT"))
    rows = df.select("user_id", F.struct("s", "id", block.alias("block")).alias("x"))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["block"]), "\n").alias("ics"))


def export_instances(instances: DataFrame, venues: DataFrame, to: str, text: str = "description") -> tuple[DataFrame, DataFrame]:
    """Listings for a client, as two outputs of one stored pass: (narrow, wide).

    narrow (n, json): one object for each listing with its number n, program, venue as a place in the table of venues (id, name)
    (null where that has no such venue) and its instances as [day, s, e, flags]. wide (n, text): the long text of those that have
    one. Numbers run through the listings in order of id; both outputs are written under ``to``, and joined by n give the input."""
    flags = F.col("eu").cast("int") + F.col("ad").cast("int") * 4 + F.col("og").cast("int") * 8
    one = F.struct("day", F.concat(F.lit("["), F.concat_ws(",", "day", "s", "e", flags), F.lit("]")).alias("text"))
    rows = instances.groupBy("id").agg(F.first("program").alias("program"), F.first("venue").alias("venue"), F.first(text).alias("text"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["text"]), ",").alias("i"))
    places = numbered(venues.select(F.col("id").alias("venue"), F.col("name").alias("venue_name")), [F.col("venue")], "v").withColumn("v", F.col("v") - 1)
    rows = numbered(rows.join(places, "venue", "left"), [F.col("id")], "n")
    quoted = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    json = F.concat(F.lit('{"id":'), "id", F.lit(',"p":'), quoted(F.col("program")), F.lit(',"v":'), F.coalesce(F.col("v").cast("string"), F.lit("null")), F.lit(',"vn":'), F.when(F.col("venue_name").isNull(), "null").otherwise(quoted(F.col("venue_name"))), F.lit(',"i":['), "i", F.lit("]}"))
    stored = f"{to}/rows"
    rows.select("n", json.alias("json"), "text").write.parquet(stored)
    both = rows.sparkSession.read.parquet(stored)
    both.select("n", "json").write.parquet(f"{to}/narrow")
    both.filter(F.col("text").isNotNull()).select("n", "text").write.parquet(f"{to}/wide")
    return rows.sparkSession.read.parquet(f"{to}/narrow"), rows.sparkSession.read.parquet(f"{to}/wide")
