"""tamisol: Spark-native name screening, alert scoring and data preparation."""
