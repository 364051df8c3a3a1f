"""Tables written once to the shared folder, so that several passes read them and lost executors don't cost them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..functions.staging import checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the folder of ``spark.checkpoint.dir``: columns compressed, where ``stage`` keeps plain rows.

    The folder is the cluster's scratch space; tables in it are not read again once a query has ended.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
