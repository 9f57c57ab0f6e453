"""leadloom: a Spark-native engine for business-lead data."""
