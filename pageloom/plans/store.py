"""Runs that add to earlier runs, in a store that holds only what committed runs made."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.bundle import WITH_DOCUMENT, last_of_staged
from pageloom.plans.runs import run_bulk
from pageloom.session import run_scope

MANIFEST = "run long, name string, subject string, counts map<string, bigint>"


@dataclass(frozen=True)
class RunStore:
    """``path`` holds outcomes/run=n, documents among them, and, written last, manifest/run=n.

    A run counts once its row of the manifest is there, which is one file; what a run that
    broke off has left is not read, and the next run of that number writes over it. One run
    is added at a time.
    """

    spark: SparkSession
    path: str

    def manifest(self) -> DataFrame:
        """(run, name, subject, counts) of the committed runs."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/run=*")

    def outcomes(self) -> DataFrame | None:
        """All outcomes with their ``run``; None before the first run."""
        runs = [r.run for r in self.manifest().select("run").collect()]
        parts = [self.spark.read.parquet(f"{self.path}/outcomes/run={run}").withColumn("run", F.lit(run)) for run in sorted(runs)]
        if not parts:
            return None
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def documents(self) -> DataFrame | None:
        """S6 over all runs: of the documents with one key the last in (run, rank)."""
        stored = self.outcomes()
        return stored and last_of_staged(stored.filter(F.col("status").isin(*WITH_DOCUMENT)), ["run", "rank"])

    def add(self, pages: DataFrame, seed: str, **how: Any) -> dict[str, int]:
        """Run over ``pages``, leaving out the URLs that earlier runs have documents of; the counts of the run.

        Whatever the run staged is gone afterwards; its results are in the store.
        """
        earlier = self.outcomes()
        number = 1 if earlier is None else self.manifest().agg(F.max("run")).first()[0] + 1
        done = earlier and earlier.filter(F.col("status").isin(*WITH_DOCUMENT)).select(F.col("url").alias("norm_url")).distinct()
        with run_scope(self.spark):
            run = run_bulk(pages, seed, done=done, outcomes_path=f"{self.path}/outcomes/run={number}", **how)
            row = self.spark.createDataFrame([(number, run.name, run.subject, run.counts)], MANIFEST)
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/run={number}")
        return run.counts
