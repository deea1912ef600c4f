"""Streaming forms of the operators."""

#: The state store that stateful operators need, for ``spark.sql.streaming.stateStore.providerClass``.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
