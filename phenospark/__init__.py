"""A Spark-native engine for phenotype-guided expression analysis."""
