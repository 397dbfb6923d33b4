"""ledgerflow: PySpark-native analytics for ordered, hash-chained event logs, and operators for training-data pipelines."""
