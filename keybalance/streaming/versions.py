"""State and snapshots of a stream, one folder per micro-batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from keybalance.workdir import child_names, remove

# A state table holds small keyed values of several kinds: sketch cells by (lane,
# slot), keys by text, counters by kind alone, distinct sketches as they are.
STATE_SCHEMA = "column string, kind string, lane int, slot int, key string, n bigint, sketch binary"


def state_rows(
    df: DataFrame, kind: str, lane=None, slot=None, key=None, n: str | None = "n", sketch=None
) -> DataFrame:
    """``df`` as state rows of one kind."""

    def field(name, dtype):
        return (F.lit(None) if name is None else F.col(name)).cast(dtype)

    return df.select(
        "column",
        F.lit(kind).alias("kind"),
        field(lane, "int").alias("lane"),
        field(slot, "int").alias("slot"),
        field(key, "string").alias("key"),
        field(n, "bigint").alias("n"),
        field(sketch, "binary").alias("sketch"),
    )


@dataclass(frozen=True)
class Versions:
    """Folders of one stream below ``root``.

    A micro-batch reads only the state of the batch before it and overwrites its
    own, so running a batch again after a failure gives the same result.
    """

    root: str

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    @property
    def snapshots(self) -> str:
        return f"{self.root}/snapshots"

    @property
    def _blank(self) -> str:
        return f"{self.root}/blank"

    def _state(self, batch_id: int) -> str:
        return f"{self.root}/state/batch_id={batch_id}"

    def previous(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self.state(spark, batch_id - 1)

    def state(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], STATE_SCHEMA)
        return spark.read.schema(STATE_SCHEMA).parquet(self._state(batch_id))

    def save_state(self, state: DataFrame, batch_id: int) -> DataFrame:
        # A state is at most a few ten thousand rows per column: few files. They are shuffled, as
        # coalescing would run all partitions of the query before in these few tasks.
        state.repartition(4).write.mode("overwrite").parquet(self._state(batch_id))
        # A replay reads the version before its own; older ones are done with.
        remove(state.sparkSession, self._state(batch_id - 2))
        return self.state(state.sparkSession, batch_id)

    def save_blank(self, profiles: DataFrame) -> None:
        """The profile of no rows, for a stream that never has any."""
        profiles.repartition(1).write.mode("overwrite").parquet(self._blank)

    def save_snapshot(self, profiles: DataFrame, batch_id: int) -> None:
        profiles.repartition(1).write.mode("overwrite").parquet(
            f"{self.snapshots}/batch_id={batch_id}"
        )

    def all_snapshots(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.snapshots)

    def last_batch(self, spark: SparkSession) -> int | None:
        """Id of the newest snapshot, from the names of the folders; None before the first."""
        names = child_names(spark, self.snapshots)
        return max((int(n.partition("=")[2]) for n in names if n.startswith("batch_id=")), default=None)

    def latest(self, spark: SparkSession) -> DataFrame:
        """The newest snapshot: the profile of everything read so far."""
        last = self.last_batch(spark)
        return spark.read.parquet(
            self._blank if last is None else f"{self.snapshots}/batch_id={last}"
        )
