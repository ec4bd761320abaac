"""Event logs of past applications: text lines in, one row per application or stage out.

Lines are told apart by a text test before any JSON is decoded, and every line
is read and decoded once, into the few fields that are wanted. The many task and
stage lines are summed up per stage by hash aggregation before the shuffle. The
few lines that carry texts are groups of their own there, since texts as
aggregated values would force a sort of all rows; a log is then put together
from its stages and these lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.functions.numeric import truthy_or
from jobsight.functions.units import memory_mb

APP_START, APP_END = "SparkListenerApplicationStart", "SparkListenerApplicationEnd"
ENVIRONMENT = "SparkListenerEnvironmentUpdate"
TASK_END, STAGE_DONE = "SparkListenerTaskEnd", "SparkListenerStageCompleted"
HEAD_EVENTS = [APP_START, APP_END, ENVIRONMENT]
WORK_EVENTS = [TASK_END, STAGE_DONE]
WANTED = HEAD_EVENTS + WORK_EVENTS

# Field names of the log format. Old and current writers differ in the shuffle and failure fields.
HEAD_SCHEMA = "`Event` STRING, `App ID` STRING, `App Name` STRING, `User` STRING, `Timestamp` BIGINT, `Spark Properties` STRING"
WORK_SCHEMA = """
`Event` STRING, `Stage ID` INT, `Stage Info` STRUCT<`Stage ID`: INT, `Stage Name`: STRING>,
`Task Info` STRUCT<`Task ID`: BIGINT, `Successful`: BOOLEAN, `Failed`: BOOLEAN, `Killed`: BOOLEAN>,
`Task Metrics` STRUCT<
  `Executor Run Time`: BIGINT, `Executor CPU Time`: BIGINT, `JVM GC Time`: BIGINT, `Peak Execution Memory`: BIGINT,
  `Memory Bytes Spilled`: BIGINT, `Disk Bytes Spilled`: BIGINT,
  `Input Metrics`: STRUCT<`Bytes Read`: BIGINT>, `Output Metrics`: STRUCT<`Bytes Written`: BIGINT>,
  `Shuffle Read Metrics`: STRUCT<`Total Bytes Read`: BIGINT, `Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT>,
  `Shuffle Write Metrics`: STRUCT<`Bytes Written`: BIGINT, `Shuffle Bytes Written`: BIGINT>>
"""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every log below ``path`` as (log, line, position). Hidden files are left out, gzip is read by its extension.

    The parts of a rolling log share the folder they are in as their key; their numbers come first in the position.
    """
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"^events_(\d+)_", 1).try_cast("long"), F.lit(0))
    # Lines of one block are read in order by one task, so the id orders them; blocks are ordered by where they start.
    position = F.struct(part, "_metadata.file_block_start", F.monotonically_increasing_id())
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    return as_lines(raw.select(F.col("_metadata.file_path").alias("file"), "value", position.alias("position")))


def as_lines(raw: DataFrame) -> DataFrame:
    """(file, value) -> (log, line); a position stays."""
    folder = F.regexp_extract("file", r"^(.*/eventlog_v2_[^/]+)/[^/]+$", 1)
    return raw.select(F.coalesce(F.nullif(folder, F.lit("")), F.col("file")).alias("log"), F.col("value").alias("line"), *_position(raw))


def _position(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c == "position"]


def decode(lines: DataFrame, events: list[str] = WANTED, schema: str | None = None) -> DataFrame:
    """Decoded events of the wanted types; a line that is no JSON is dropped here and shown by ``rejects``."""
    fields = schema or (HEAD_SCHEMA + "," + WORK_SCHEMA.replace("`Event` STRING,", "", 1))
    hinted = lines.filter(F.col("line").rlike(rf'"Event"\s*:\s*"({"|".join(events)})"'))
    # inline keeps the filter behind the decoding; pushed before it, the filter would decode every line again
    return hinted.select("log", *_position(lines), F.inline(F.array(F.from_json("line", fields)))).filter(F.col("Event").isin(events))


def rejects(lines: DataFrame) -> DataFrame:
    """Non-empty lines that are not JSON, for the quarantine table."""
    return lines.filter((F.trim("line") != "") & F.try_parse_json("line").isNull())


def _is(event: str) -> Column:
    return F.col("Event") == event


def _m(path: str) -> Column:
    parts = ".".join(f"`{p}`" for p in path.split("/"))
    return F.coalesce(F.col(f"`Task Metrics`.{parts}"), F.lit(0))


def _failed() -> Column:
    info = "`Task Info`"
    return (
        ~F.coalesce(F.col(f"{info}.Successful"), F.lit(True))
        | F.coalesce(F.col(f"{info}.Failed"), F.lit(False))
        | F.coalesce(F.col(f"{info}.Killed"), F.lit(False))
    )


TASK_SUMS = [
    "total_tasks", "failed_tasks", "input_bytes", "output_bytes", "shuffle_read_bytes", "shuffle_write_bytes",
    "memory_spilled_bytes", "disk_spilled_bytes", "executor_run_time_ms", "executor_cpu_time_ms", "jvm_gc_time_ms",
    "peak_memory_usage",
]


def _task_values() -> dict[str, Column]:
    """What a task-end event adds to the sums; the peak is a maximum."""
    shuffle_read = F.greatest(
        _m("Shuffle Read Metrics/Total Bytes Read"),
        _m("Shuffle Read Metrics/Remote Bytes Read") + _m("Shuffle Read Metrics/Local Bytes Read"),
    )
    shuffle_write = F.greatest(_m("Shuffle Write Metrics/Bytes Written"), _m("Shuffle Write Metrics/Shuffle Bytes Written"))
    values = [
        F.lit(1),
        _failed().cast("int"),
        _m("Input Metrics/Bytes Read"),
        _m("Output Metrics/Bytes Written"),
        shuffle_read,
        shuffle_write,
        _m("Memory Bytes Spilled"),
        _m("Disk Bytes Spilled"),
        _m("Executor Run Time"),
        _m("Executor CPU Time"),
        _m("JVM GC Time"),
        _m("Peak Execution Memory"),
    ]
    return dict(zip(TASK_SUMS, values))


def _folded(lines: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Sums per log, stage and ``by`` over one reading of the lines; ``completed`` counts stage-completed events.

    Texts are keys here, never aggregated values, so all rows are summed up by hash before the shuffle.
    """
    task = _is(TASK_END)
    stage = F.when(task, F.col("`Stage ID`")).when(_is(STAGE_DONE), F.col("`Stage Info`.`Stage ID`"))
    sums = [
        (F.max if name == "peak_memory_usage" else F.sum)(F.when(task, value)).alias(name)
        for name, value in _task_values().items()
    ]
    keys = [stage.alias("stage_id"), *[v.alias(k) for k, v in by.items()]]
    return decode(lines).groupBy("log", *keys).agg(F.count_if(_is(STAGE_DONE)).alias("completed"), *sums)


def _totals(cpu_unit: str) -> list[Column]:
    """Folded rows into totals. Current writers give CPU time in ns, old ones in ms."""
    totals = {
        name: F.coalesce((F.max if name == "peak_memory_usage" else F.sum)(name), F.lit(0)).cast("long") for name in TASK_SUMS
    }
    if cpu_unit == "ns":
        totals["executor_cpu_time_ms"] = F.floor(totals["executor_cpu_time_ms"] / 1000000).cast("long")
    return [total.alias(name) for name, total in totals.items()]


def _head(lines: DataFrame) -> Column:
    """The fields of an event that carries texts, as a key of its own; null for task and stage events."""
    names = ["Event", "App ID", "App Name", "User", "Timestamp", "Spark Properties"]
    fields = [F.col(f"`{n}`").alias(n.replace(" ", "_").lower()) for n in names]
    return F.when(F.col("Event").isin(HEAD_EVENTS), F.struct(*fields, *_position(lines)))


def _first_properties(lines: DataFrame) -> Column:
    """Properties of the first environment event by position; of lines without one, the least text."""
    text = F.when(F.col("head.event") == ENVIRONMENT, F.col("head.spark_properties"))
    if not _position(lines):
        return F.min(text)
    return F.min_by(text, F.when(text.isNotNull(), F.col("head.position")))


def properties(text: Column) -> Column:
    """Settings map from its JSON, an object in current logs, a list of pairs in old ones.

    Of pairs with the same name the last wins; a pair that lacks its name or value is left out.
    """
    whole = lambda p: (F.size(p) >= 2) & F.get(p, 0).isNotNull()
    pairs = F.filter(F.from_json(text, "array<array<string>>"), whole)
    names = F.array_distinct(F.transform(pairs, lambda p: F.get(p, 0)))
    last = lambda name: F.get(F.element_at(F.filter(pairs, lambda p: F.get(p, 0) == name), -1), 1)
    from_pairs = F.map_from_arrays(names, F.transform(names, last))
    return F.when(F.ltrim(text).startswith("["), from_pairs).otherwise(F.from_json(text, "map<string,string>"))


def applications(lines: DataFrame, cpu_unit: str = "ns") -> DataFrame:
    """One row per log that has a start event; end and duration are null while the application runs."""
    kind, at = F.col("head.event"), F.col("head.timestamp")
    start = F.struct("head.app_id", "head.app_name", "head.user", "head.timestamp")
    # A folded row without a head is one stage of a log, so completed stages are counted, not told apart again
    grouped = (
        _folded(lines, {"head": _head(lines)})
        .groupBy("log")
        .agg(
            F.min_by(F.when(kind == APP_START, start), F.when(kind == APP_START, at)).alias("start"),
            F.min(F.when(kind == APP_END, at)).alias("end_ms"),
            _first_properties(lines).alias("props"),
            F.count_if((F.col("completed") > 0) & F.col("stage_id").isNotNull()).alias("total_stages"),
            *_totals(cpu_unit),
        )
        .filter(F.col("start").isNotNull())
        .withColumn("spark_configs", properties(F.col("props")))
    )
    conf = F.col("spark_configs")

    def setting(name: str, default: str) -> Column:
        return F.coalesce(conf[name], F.lit(default))

    # Settings that are absent count as one core, one executor and 1g
    return grouped.select(
        "log",
        F.coalesce("start.app_id", F.lit("unknown")).alias("app_id"),
        F.coalesce("start.app_name", F.lit("unknown")).alias("app_name"),
        F.coalesce("start.user", F.lit("unknown")).alias("user_name"),
        F.timestamp_millis("start.timestamp").alias("start_time"),
        F.timestamp_millis("end_ms").alias("end_time"),
        (F.col("end_ms") - F.col("start.timestamp")).alias("duration_ms"),
        setting("spark.executor.cores", "1").try_cast("int").alias("executor_cores"),
        memory_mb(setting("spark.executor.memory", "1g")).cast("int").alias("executor_memory_mb"),
        setting("spark.executor.instances", "1").try_cast("int").alias("num_executors"),
        memory_mb(setting("spark.driver.memory", "1g")).cast("int").alias("driver_memory_mb"),
        setting("spark.driver.cores", "1").try_cast("int").alias("driver_cores"),
        "total_stages",
        *TASK_SUMS,
        "spark_configs",
    )


def stages(lines: DataFrame, cpu_unit: str = "ns") -> DataFrame:
    """One row per log and stage with its task sums; the name comes from the stage-completed event.

    Stages without a task have no row, tasks without a stage share one of their log without a name.
    """
    named = F.when(F.col("`Stage Info`.`Stage ID`").isNotNull(), F.col("`Stage Info`.`Stage Name`"))
    folded = _folded(lines, {"stage_name": F.when(_is(STAGE_DONE), named)})
    grouped = folded.groupBy("log", "stage_id").agg(*_totals(cpu_unit), F.max("stage_name").alias("stage_name"))
    return grouped.filter(F.col("total_tasks") > 0).withColumnRenamed("total_tasks", "num_tasks")


def flat_or_nested(record: DataFrame) -> DataFrame:
    """Job records whose numbers may sit in ``configuration`` / ``metrics`` or at the top; zero counts as missing."""
    out = record
    for group, names in {
        "configuration": ["executor_cores", "num_executors"],
        "metrics": [
            "total_tasks", "failed_tasks", "total_stages", "failed_stages", "input_bytes", "output_bytes",
            "shuffle_read_bytes", "shuffle_write_bytes", "memory_spilled_bytes", "disk_spilled_bytes",
        ],
    }.items():
        nested = set(record.schema[group].dataType.fieldNames()) if group in record.columns else set()
        for n in names:
            if n in nested and n in record.columns:
                out = out.withColumn(n, truthy_or(F.col(f"{group}.{n}"), F.col(n)))
            elif n in nested:
                out = out.withColumn(n, F.col(f"{group}.{n}"))
    return out
