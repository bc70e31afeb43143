"""Long runs that can stop anywhere: asking under a cap of spend, and stages whose transitions are logged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesignal.sources.readers import read_or_empty

VERDICTS = "key string, verdict string, cost double, status string, asked_in bigint"


class CapReached(RuntimeError):
    """What may be spent is spent; names are left."""


class MeteredVerdicts:
    """Verdicts on keys, each asked once and kept for good below `path`, with what each call cost in the same row, so neither can be there without the other.

    ask(key) gives (verdict, cost) and raises for a failure that may pass; such a call's cost (failed_cost) is kept, but no verdict, so the key is asked again in a later run. Keys are asked in waves of as many as surely fit what is left (`dearest` a call), so the cap holds whatever calls cost, and a wave is committed before the next begins: a run that is stopped, or a batch that is replayed, asks again for nothing but what a wave cut short had not committed. most_wave bounds that loss.
    """

    def __init__(self, path: str, ask: Callable[[str], tuple[str, float]], cap: float, dearest: float, failed_cost: float = 0.0, most_wave: int = 1000):
        self.path, self.ask, self.cap, self.dearest, self.failed_cost, self.most_wave = path, ask, cap, dearest, failed_cost, most_wave

    def known(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, self.path, VERDICTS)

    def spent(self, spark: SparkSession) -> float:
        return float(self.known(spark).agg(F.sum(F.col("cost").cast("decimal(18,6)"))).first()[0] or 0)

    def missing(self, keys: DataFrame) -> DataFrame:
        """Keys without a verdict."""
        good = self.known(keys.sparkSession).filter("status = 'ok'").select("key").distinct()
        return keys.filter("key is not null").select("key").distinct().join(good, "key", "left_anti")

    def __call__(self, keys: DataFrame, batch_id: int = 0) -> None:
        """Asks for the keys of a batch (foreachBatch). Keys that failed are not asked again in the same call. CapReached when the next call might go over the cap while keys are left; the batch then counts as not done."""
        spark = keys.sparkSession
        failed = spark.createDataFrame([], "key string")
        while True:
            left = self.missing(keys).join(failed, "key", "left_anti")
            able = min(self.most_wave, int((self.cap - self.spent(spark)) / self.dearest + 1e-9))
            if able < 1:
                if left.isEmpty():
                    return
                raise CapReached(f"{self.cap} are spent")
            wave = left.orderBy("key").limit(able)
            asked = wave.mapInPandas(self._asked(batch_id), VERDICTS)
            before = self.known(spark).count()
            asked.write.mode("append").parquet(self.path)
            if self.known(spark).count() == before:
                return
            failed = self.known(spark).filter((F.col("asked_in") == batch_id) & (F.col("status") == "failed")).select("key").distinct()

    def _asked(self, batch_id: int):
        ask, failed_cost = self.ask, self.failed_cost

        def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for key in batch["key"]:
                    try:
                        verdict, cost = ask(key)
                        rows.append((key, verdict, cost, "ok", batch_id))
                    except Exception:  # noqa: BLE001  whatever a remote call raises may pass
                        rows.append((key, None, failed_cost, "failed", batch_id))
                yield pd.DataFrame(rows, columns=["key", "verdict", "cost", "status", "asked_in"])

        return calls


#: What a stage says of a lot: a stage to go to, or one of these: it stays and is tried again in a later run.
FAILED, DEFERRED = "failed", "deferred"
LOG = "lot bigint, stage string, came_from string, detail string, run bigint, step int"

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


class StageLog:
    """Transitions of lots between stages below `path`, a folder for each run and step. Writing a step again replaces it, so a step that is repeated after a stop, or a batch that is replayed, leaves one set of transitions; nothing that another step wrote is touched."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def transitions(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, LOG)

    def state(self, run: int | None = None, step: int | None = None) -> DataFrame:
        """(lot, stage, detail) after all transitions, or as it was before a step of a run. Rows that failed or were deferred leave the stage as it was."""
        rows = self.transitions()
        if run is not None:
            rows = rows.filter((F.col("run") < run) | (F.col("run") == run) & (F.col("step") < step))
        moved = rows.filter(~F.col("stage").isin(FAILED, DEFERRED))
        return moved.groupBy("lot").agg(F.max_by(F.struct("stage", "detail"), F.struct("run", "step")).alias("s")).select("lot", "s.stage", "s.detail")

    def done(self, run: int, step: int) -> bool:
        return not read_or_empty(self.spark, f"{self.path}-done", "run bigint, step int").filter((F.col("run") == run) & (F.col("step") == step)).isEmpty()

    def write(self, rows: DataFrame, run: int, step: int) -> None:
        """rows: lot, stage, came_from, detail. The step is marked as done after its rows are there."""
        columns = [F.col("lot").cast("bigint"), F.col("stage").cast("string"), F.col("came_from").cast("string"), F.col("detail").cast("string")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/run={run}/step={step}")
        self.spark.range(1).select(F.lit(run).cast("bigint").alias("run"), F.lit(step).alias("step")).coalesce(1).write.mode("append").parquet(f"{self.path}-done")


def run_stages(log: StageLog, entering: DataFrame, stages: list[Stage], run: int) -> None:
    """One run: lots of `entering` (lot, detail) that are not known enter the first stage; then each stage takes all lots that are in it, also those that stayed in earlier runs. A stage is a name and a function of (lot, detail) giving (lot, stage, detail), where stage is the next one, FAILED or DEFERRED; a lot that it gives no row for stays.

    Steps that this run has finished are skipped and what a step reads are the transitions before it, so a run that stops anywhere and is started again with the same number ends like one that was never stopped. A step that raises marks nothing.
    """
    if not log.done(run, 0):
        fresh = entering.join(log.state(run, 0).select("lot"), "lot", "left_anti").dropDuplicates(["lot"])
        log.write(fresh.select("lot", F.lit(stages[0][0]).alias("stage"), F.lit(None).alias("came_from"), "detail"), run, 0)
    for step, (name, work) in enumerate(stages, 1):
        if not log.done(run, step):
            own = log.state(run, step).filter(F.col("stage") == name).select("lot", "detail")
            log.write(work(own).select("lot", "stage", F.lit(name).alias("came_from"), "detail"), run, step)


def each_batch(log: StageLog, stages: list[Stage]):
    """run_stages for foreachBatch: the batch's number is the run's, so a replayed batch goes on where it stopped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        run_stages(log, batch, stages, batch_id)

    return write


def outcome_counts(log: StageLog) -> DataFrame:
    """(run, came_from, stage, lots): what each run did."""
    return log.transitions().groupBy("run", "came_from", "stage").agg(F.count("*").alias("lots"))


def moved(rows: DataFrame, to: Column | str, detail: Column | None = None) -> DataFrame:
    """rows as a stage's answer."""
    return rows.select("lot", (F.lit(to) if isinstance(to, str) else to).alias("stage"), (F.col("detail") if detail is None else detail).alias("detail"))
