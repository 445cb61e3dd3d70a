"""The row-wise stages on a stream of complaint files.

Mapping, cleaning and event features are narrow projections, so they run unchanged on a
streaming source. No stateful operator is offered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens import schemas
from cohortlens.operators import complaints


def read_complaint_stream(spark: SparkSession, folder: str, *, files_per_trigger: int = 64) -> DataFrame:
    """New tab-separated complaint files of a folder as they arrive."""
    return (
        spark.readStream.schema(schemas.COMPLAINT_SOURCE)
        .option("sep", "\t")
        .option("quote", "")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", "\n")
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
    )


def event_feature_stream(raw: DataFrame) -> DataFrame:
    return complaints.event_features(complaints.clean_complaints(complaints.map_complaints(raw)))
