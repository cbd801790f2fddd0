"""Cut lineage by writing to the shared folder and reading back."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerline.session import remove_path, scratch_path


def materialise(frame: DataFrame, label: str, most: int = 0) -> DataFrame:
    """The same rows from Parquet in the shared folder: costly steps run once, lost executors cost nothing.

    Readers take thousands of rows of a file into memory at once; of large rows a file gets ``most`` at most.
    """
    path = scratch_path(frame.sparkSession, label)
    frame.write.option("maxRecordsPerFile", most).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Delete what ``materialise`` wrote for a frame that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        remove_path(frame.sparkSession, folder)


def is_stored(frame: DataFrame) -> bool:
    """Whether a frame only selects from columnar files, so that reading it again costs no work."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.simpleString(200).rstrip().endswith(("parquet", "orc"))
