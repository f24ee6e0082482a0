"""Import of quarters as a stream: every row's outcome from the state store, without reading the table.

Rows are landed as Parquet below ``filing_period=…`` folders, a file as soon as it is there. The stream takes the new
files of a batch; keys, fingerprints and places of their candidates are staged with the batch's number. A second stream
reads these and keeps, of every key that was ever stored, the first place: an aggregation in the state store, whose order
is the number of the batch, so that it depends on no clock. It has ruled on a batch before the next one starts. The rows
themselves are read from the batch's own files when their outcomes are written, and new ones are appended. What one key
holds in memory does not grow with its rows.

A quarter is done when as many rows were received as its manifest announced. Done quarters are skipped when a stream
starts, those that are partial or unknown are taken up again. A batch that is replayed keeps the outcomes that it had
written; a row delivered late or once more is a DUPLICATE, whenever it comes. A stream that starts anew over a table
with rows is given their keys as its first state. The staged keys and the second stream's checkpoint lie beside the
stream's checkpoint (``…-keys``, ``…-rulings``) and belong to it.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark import schemas
from tidemark.functions import hashing
from tidemark.operators import access, accounting, changes, sinks
from tidemark.schemas import Table
from tidemark.session import written

Judge = Callable[[DataFrame], DataFrame]

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A file's number among those of its batch, in the order of their names, and the row in it.
PLACE = ("_file_no", "_row")
#: The batch of rows that were stored before the stream's first start.
BEFORE = -1
#: Staged keys are read whatever their files' times say.
ANY_AGE = "36500d"
COMPLETED, PARTIAL = "COMPLETED", "PARTIAL"


def _print_of(table: Table) -> Column:
    return F.col(table.hash_column) if table.hash_column else F.lit("")


def _text_key(table: Table) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in table.key]


def _staged(rows: DataFrame, table: Table) -> DataFrame:
    """Key, fingerprint and place, as they go into the state. A fingerprint that is a part of the key is left out."""
    kept = F.lit("") if table.hash_column in table.key else _print_of(table)
    return rows.select(*_text_key(table), *PLACE, kept.alias("_print"))


def _batch_path(root: str, batch_id: int) -> str:
    return f"{root}/batch_id={batch_id}"


def rulings(staged: DataFrame, table: Table) -> DataFrame:
    """The stateful step over a stream of staged keys: of every key in it, the first place of all batches. Keys are text."""
    place = F.struct("batch_id", *PLACE, "_print")
    return staged.groupBy(*table.key).agg(F.min(place).alias("_first"))


def _ruled(spark: SparkSession, session: SparkSession, table: Table, checkpoint: str, batch_id: int) -> DataFrame:
    """Bring the state up to date with all staged keys; returns the rulings on those of the batch.

    A replay finds its rulings written, or has them made again: batch and place are the same then, and so is the first.
    ``session`` is the outer stream's own, whose settings nobody else sees.
    """
    keys, out = f"{checkpoint}-keys", _batch_path(f"{checkpoint}-rulings/ruled", batch_id)
    ddl = ", ".join([*[f"{c} string" for c in table.key], "_file_no int, _row bigint, _print string, batch_id bigint"])
    session.conf.set(PROVIDER, ROCKS)
    ruled = rulings(session.readStream.schema(ddl).option("maxFileAge", ANY_AGE).parquet(keys), table)
    query = ruled.writeStream.outputMode("update").foreachBatch(
        lambda batch, number: batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/part={number}")).option(
        "checkpointLocation", f"{checkpoint}-rulings/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(ruled.schema).parquet(out)


def _outcomes(rows: DataFrame, ruled: DataFrame, table: Table, batch_id: int) -> DataFrame:
    """``rows`` with the outcome that follows from their key's ruling."""
    named = ruled.select(*[F.col(c).alias(f"_of_{c}") for c in table.key], "_first")
    same_key = [F.col(c).cast("string").eqNullSafe(F.col(f"_of_{c}")) for c in table.key]
    joined = rows.join(named, same_key, "left")
    first = (F.col("_first.batch_id") == batch_id) & (F.col("_file_no") == F.col("_first._file_no")) & (
        F.col("_row") == F.col("_first._row"))
    same = F.lit(True) if table.hash_column in table.key else _print_of(table) == F.col("_first._print")
    outcome = F.coalesce("outcome", F.when(first, sinks.INSERTED).when(same, sinks.DUPLICATE).otherwise(sinks.CONFLICT))
    return joined.withColumn("outcome", outcome).drop(*[c for c in named.columns])


def _path(spark: SparkSession, name: str) -> str:
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)).toString()


def _batch_rows(spark: SparkSession, names: list[str], schema: StructType | str, folder: str) -> DataFrame:
    """The rows of a batch's files with their places; as many names as files are taken in a batch."""
    numbered = spark.createDataFrame([(name, number) for number, name in enumerate(names)], "_file string, _file_no int")
    rows = spark.read.schema(schema).option("basePath", folder).parquet(*[_path(spark, name) for name in names])
    placed = rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    return placed.join(F.broadcast(numbered), "_file")


def store_batch(spark: SparkSession, taken: DataFrame, batch_id: int, schema: StructType | str, folder: str, judge: Judge,
                table: Table, path: str, outcome_path: str, checkpoint: str, created_at: datetime.datetime) -> None:
    """Write one batch's outcomes, then append its new rows. Done again, it keeps the outcomes and appends what is missing."""
    keys, done = _batch_path(f"{checkpoint}-keys", batch_id), _batch_path(outcome_path, batch_id)
    names = sorted(r[0] for r in taken.distinct().collect())
    if not names:
        return
    rows = judge(_batch_rows(spark, names, schema, folder))
    # Staged keys that were complete are not written again: the second stream may have begun to read them.
    if not written(spark, keys):
        _staged(rows.where(F.col("outcome").isNull()), table).write.mode("overwrite").option("compression", "zstd").parquet(keys)
    decided = _ruled(spark, taken.sparkSession, table, checkpoint, batch_id)
    resumed = written(spark, done)
    if not resumed:
        known = [c for c in dict.fromkeys([*table.key, *filter(None, [table.hash_column]), *table.partition_by, "reason", "errors",
                                           "_file", *PLACE]) if c in rows.columns]
        _outcomes(rows.select(*known, "outcome"), decided, table, batch_id).write.mode("overwrite").option("compression", "zstd").parquet(done)
    new = spark.read.parquet(done).where(F.col("outcome") == sinks.INSERTED).select(*PLACE)
    # Decided rows are none of the new ones; fingerprints travel as bytes.
    open_rows = hashing.packed(rows.where(F.col("outcome").isNull()), table.hash_column)
    fresh = hashing.unpacked(open_rows.join(new, list(PLACE), "left_semi"), table.hash_column)
    if resumed:
        ranged = schemas.ranged(fresh, table)
        fresh = fresh.join(sinks.stored_for(spark, ranged, table, path).select(*table.key), list(table.key), "left_anti")
    fresh = fresh.select(*[c for c in fresh.columns if c in table.columns])
    if "created_at" in table.columns:
        fresh = fresh.withColumn("created_at", F.lit(created_at))
    schemas.append(fresh, table, path)


def land(spark: SparkSession, folder: str, schema: StructType | str, judge: Judge, table: Table, path: str, outcome_path: str,
         checkpoint: str, created_at: datetime.datetime, files_per_batch: int = 100, skip: list[str] = (),
         known: DataFrame | None = None) -> StreamingQuery:
    """Store what has landed in ``folder``, batch by batch, and return the running query.

    ``judge`` adds the table's columns and ``outcome``: a row that has one already (rejected, skipped) is no candidate.
    ``skip`` names quarters that are done. ``known`` has the key and fingerprint of rows stored before the stream's first
    start; it is needed once, when a new checkpoint meets a table with rows.
    """
    checkpoint = checkpoint.rstrip("/")
    before = _batch_path(f"{checkpoint}-keys", BEFORE)
    if known is not None and not written(spark, before):
        nowhere = {"_file_no": F.lit(None).cast("int"), "_row": F.lit(None).cast("bigint")}
        _staged(known.where(_print_of(table).isNotNull()).withColumns(nowhere), table).write.mode("overwrite").option("compression", "zstd").parquet(before)
    landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    if skip:
        landed = landed.where(~F.col("filing_period").isin(*skip))
    return landed.select("_metadata.file_path").writeStream.foreachBatch(lambda taken, number: store_batch(
        spark, taken, number, schema, folder, judge, table, path, outcome_path, checkpoint, created_at)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def done_quarters(spark: SparkSession, state_path: str, force: bool = False) -> list[str]:
    """Quarters that need no import; a list as long as there are quarters."""
    if force:
        return []
    state = changes.current(spark, schemas.INGESTION_STATE, state_path, "completed_at")
    pending = access.pending_periods(state.select("period"), state)
    return sorted(r[0] for r in state.select("period").join(pending, "period", "left_anti").collect())


def record_quarters(spark: SparkSession, outcome_path: str, manifest: DataFrame, state_path: str, at: datetime.datetime,
                    delivery: int) -> DataFrame:
    """State of every quarter that rows were received of, from the outcomes: COMPLETED once as many rows were received
    as ``manifest`` (period, rows) announces, else PARTIAL. Returns what was recorded."""
    stats = accounting.quarter_stats(spark.read.parquet(outcome_path))
    status = F.when(F.col("records_parsed") >= F.col("rows"), COMPLETED).otherwise(PARTIAL)
    state = stats.join(manifest.select("period", "rows"), "period", "left").withColumns({
        "status": status, "completed_at": F.lit(at)}).drop("rows")
    changes.upsert(state, schemas.INGESTION_STATE, state_path, "completed_at", delivery)
    return state
