"""State variables and timers of streams need a state store that can look up single keys."""

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def use_state_variables(spark: SparkSession) -> None:
    """Use RocksDB for the streams started from now on, unless the session names a store of its own."""
    if spark.conf.get(PROVIDER, DEFAULT) == DEFAULT:
        spark.conf.set(PROVIDER, ROCKSDB)
