"""Session helpers."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Texts differ in length a thousandfold, so batches to Python are bounded by bytes; a setting made by the user stays.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4194304"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    if (app := spark.sparkContext.applicationId) not in _SHIPPED:
        _SHIPPED.add(app)
        top = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="ship-"), "lumenspan.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(p := os.path.join(d, n), os.path.relpath(p, os.path.dirname(top)))
        spark.sparkContext.addPyFile(to)
        if BATCH_KEY not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
            spark.conf.set(BATCH_KEY, BATCH_BYTES)
    return spark


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent to the executors first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ship(spark), sf_dir)

    return run


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
