"""Listings, manifests, ledgers and logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.functions.shared import shared_folder

#: What counts as video, as image and as voice reference.
VIDEO_EXT = ("mp4", "mov", "avi", "mkv", "webm", "flv", "wmv")
IMAGE_EXT = ("png", "jpg", "jpeg", "webp", "bmp", "tiff", "tif")
VOICE_EXT = ("wav", "mp3", "flac", "m4a", "ogg", "opus", "mp4", "mkv", "mov", "avi", "webm", "m4v")

SEGMENT = T.ArrayType(T.StructType([T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))
ENTRIES = T.StructType([
    T.StructField("media_path", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("caption", T.StringType()),
    T.StructField("characters", T.ArrayType(T.StringType())),
    T.StructField("transcript", T.StringType()),
    T.StructField("transcript_segments", SEGMENT),
    T.StructField("reference_path", T.StringType()),
])


def base_name(path):
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem_of(path):
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension_of(path):
    """Last extension of a file name, in lower case and without its dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Path, length and time of the files of a folder, in any store that Spark reads; the files themselves are not opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(folder).select("path", "length", "modificationTime")


def scan_media(files: DataFrame, video_ext: tuple[str, ...] = VIDEO_EXT, image_ext: tuple[str, ...] = IMAGE_EXT) -> DataFrame:
    """Files of a listing that are videos or images and whose name doesn't begin with '_', with their kind.

    The order of a listing is its path column; consumers sort where they need it.
    """
    ext = extension_of("path")
    kind = F.when(ext.isin(*video_ext), "video").when(ext.isin(*image_ext), "image")
    return files.where(~base_name("path").startswith("_")).withColumns({"ext": ext, "kind": kind}).where(F.col("kind").isNotNull())


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with all optional fields; what can't be read as a list of objects gives no rows. An absent key is null."""
    rows = spark.read.schema(ENTRIES).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("media_path").isNotNull() | F.col("source_file").isNotNull())


def portable_paths(entries: DataFrame, root: str) -> DataFrame:
    """Paths under root become relative with forward slashes, others stay."""
    path = F.translate("media_path", "\\", "/")
    prefix = root.rstrip("/") + "/"
    return entries.withColumn("media_path", F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(F.col("media_path")))


class Conflict(Exception):
    """Somebody else has written a version meanwhile."""


def _store(spark: SparkSession, folder: str):
    """The folder's path and its file system, whatever the store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    path, fs = _store(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def _versions(spark: SparkSession, log: str) -> list[int]:
    """Numbers of the versions that a log names."""
    return [int(n.removesuffix(".json")) for n in _names(spark, log) if n.endswith(".json")]


def _record(spark: SparkSession, log: str, version: int) -> dict:
    """What the log says about a version."""
    return json.loads(spark.read.text(f"{log}/{version:09d}.json", wholetext=True).first().value)


def _commit(spark: SparkSession, log: str, version: int, record: dict) -> None:
    """Add a version to the log, as a file that must not be there yet; Conflict if it is.

    The record is written under another name and renamed without overwriting, so it is whole once it
    is there, and of two writers one gets the version and the other hears of it (in one step on stores such as HDFS).
    """
    jvm = spark._jvm
    (draft, fs), (path, _) = _store(spark, f"{log}/.{uuid.uuid4().hex}.draft"), _store(spark, f"{log}/{version:09d}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(record).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()) if path.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, path, never_over)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(path):
            raise Conflict(f"version {version} is there already") from e
        raise


def write_entries(entries: DataFrame, root: str, based_on: int | None = None) -> str:
    """Write a new version of the manifest beside the old ones, then a record that names it.

    The record is one more file, and nothing is replaced: after a crash the newest record still names
    a whole version, and the versions before stay readable as backups. Returns the new version's folder.

    based_on: the version that the entries were made from (0: none); if there is a newer one, nothing is
    committed and Conflict is raised. Without it the entries become the newest version whatever came before.
    """
    spark = entries.sparkSession
    log = f"{root}/manifest/current"
    target = f"{root}/manifest/v{uuid.uuid4().hex}"
    portable_paths(entries, root).write.mode("errorifexists").parquet(target)
    while True:
        newest = max(_versions(spark, log), default=0)
        if based_on is not None and newest != based_on:
            raise Conflict(f"version {newest} came after {based_on}")
        try:
            _commit(spark, log, newest + 1, {"path": target})
            return target
        except Conflict:
            if based_on is not None:
                raise


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the newest version, 0 if there is none."""
    return max(_versions(spark, f"{root}/manifest/current"), default=0)


def current_entries(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest whole version of the manifest, or the given one."""
    version = version or current_version(spark, root)
    if not version:
        raise FileNotFoundError(f"no manifest under {root}")
    return spark.read.parquet(_record(spark, f"{root}/manifest/current", version)["path"])


def update_entries(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame]) -> str:
    """Replace the manifest by what `change` makes of it. If another writer was faster, it is made again of their version, so that neither's change is lost."""
    while True:
        version = current_version(spark, root)
        try:
            return write_entries(change(current_entries(spark, root, version)), root, version)
        except Conflict:
            continue


def expire_versions(spark: SparkSession, root: str, keep: int = 5) -> int:
    """Delete all but the newest `keep` versions of the manifest, tables before records; gives their number."""
    log = f"{root}/manifest/current"
    old = sorted(_versions(spark, log))[: -max(1, keep)]
    for v in old:
        for folder in (_record(spark, log, v)["path"], f"{log}/{v:09d}.json"):
            path, fs = _store(spark, folder)
            fs.delete(path, True)
    return len(old)


def append_rejections(new: DataFrame, path: str) -> None:
    """Append records to the ledger under path, as a part of its own with a folder for each reason; what is there is not read."""
    new.write.partitionBy("reason").parquet(f"{path}/part=a{uuid.uuid4().hex}")


def _parts(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of compactions of a ledger, and its parts: all that are whole and not held by a newer one."""
    log = f"{path}/compactions"
    version = max(_versions(spark, log), default=0)
    record = _record(spark, log, version) if version else {"part": None, "holds": []}
    # the part of a compaction counts once its record is there, an append once it is whole
    live = [n for n in _names(spark, path) if n.startswith("part=a") and n not in record["holds"]]
    whole = [n for n in live if "_SUCCESS" in _names(spark, f"{path}/{n}")]
    return version, [record["part"], *whole] if record["part"] else whole


def _read_parts(spark: SparkSession, path: str, parts: list[str], schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/{n}" for n in parts)).drop("part")


def read_rejections(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The whole ledger; columns that some records lack are null."""
    return _read_parts(spark, path, _parts(spark, path)[1], schema)


def compact_rejections(spark: SparkSession, path: str, schema: str, files: int = 1) -> int:
    """Write the ledger anew as a few files for each reason and delete the parts that these hold; gives the number of parts.

    The new part counts from the moment its record is there. Appends that come meanwhile stay beside it;
    if another compaction was faster, this one is a Conflict and leaves the ledger as it is.
    """
    version, parts = _parts(spark, path)
    if not parts:
        return 0
    target = f"part=c{uuid.uuid4().hex}"
    rows = _read_parts(spark, path, parts, schema)
    # a reason may hold most rows: its rows are dealt over `files` tasks
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "reason"]), F.lit(files))
    rows.withColumn("_f", spread).repartition("reason", "_f").drop("_f").write.partitionBy("reason").parquet(f"{path}/{target}")
    _commit(spark, f"{path}/compactions", version + 1, {"part": target, "holds": parts})
    for name in parts:
        where, fs = _store(spark, f"{path}/{name}")
        fs.delete(where, True)
    return len(parts)


def artifact_inventory(artifacts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row for each stem: has_<kind> for each kind."""
    return artifacts.groupBy("stem").agg(*[F.max(F.when(F.col("kind") == k, 1).otherwise(0)).cast("int").alias(f"has_{k}") for k in kinds])


def bucketed(df: DataFrame, name: str, key: str = "stem", buckets: int | None = None) -> DataFrame:
    """df as a table of the catalogue, dealt into buckets by key and sorted in them, under a name of its own in the shared folder.

    Whoever groups by the key, or joins two such tables of as many buckets by it, shuffles neither. An
    inventory is written once so and reconciled as often as need be. buckets: as many as shuffles have partitions, if not given.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt as the buckets are, so that each bucket is one file
    dealt = df.repartition(number, key)
    dealt.write.bucketBy(number, key).sortBy(key).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def load_refs(files: DataFrame, kind: str = "character") -> DataFrame:
    """Reference files keyed by trigger (lower-case stem, _ as -) or, for locations, by label (stem, _ as space).

    kind: character and location take images, voice takes sound and the sound of videos; other files are no references.
    """
    stem = stem_of("path")
    key = F.trim(F.translate(stem, "_", " ")) if kind == "location" else F.translate(F.lower(stem), "_", "-")
    fit = files.where(extension_of("path").isin(*(VOICE_EXT if kind == "voice" else IMAGE_EXT)))
    return fit.groupBy(key.alias("ref_key")).agg(F.min("path").alias("path"))


def loss_history_flatten(history: DataFrame, column: str = "history") -> DataFrame:
    """Rows of a loss history held as JSON text: its steps, and its points of the average (kind ema); unreadable text gives none."""
    step = "struct<step:int,loss:double,lr:double,ema_loss:double,epoch:int,step_time:double>"
    parsed = F.from_json(column, f"struct<steps:array<{step}>,ema_history:array<array<double>>>")
    points = F.transform(parsed["ema_history"], lambda x: F.struct(F.lit("ema").alias("kind"), F.get(x, F.lit(0)).cast("int").alias("step"), F.get(x, F.lit(1)).alias("value")))
    steps = history.select("run_id", F.explode(parsed["steps"]).alias("s")).select("run_id", F.lit("step").alias("kind"), "s.*")
    averages = history.select("run_id", F.explode(points).alias("p")).select("run_id", "p.kind", "p.step", F.col("p.value").alias("ema_loss"))
    return steps.unionByName(averages, allowMissingColumns=True)


def parse_train_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """The step of each log line: 'step N' (any of space, : or = between) first, then '| N/M', else null."""
    named, bar = F.regexp_extract(column, r"[Ss]tep\s*[:=]?\s*(\d+)", 1), F.regexp_extract(column, r"\|\s*(\d+)/(\d+)", 1)
    return lines.withColumn("step", F.coalesce(F.nullif(named, F.lit("")), F.nullif(bar, F.lit(""))).cast("bigint"))
