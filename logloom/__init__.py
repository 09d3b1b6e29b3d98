"""logloom: Spark-native analytics over agent work logs, plus corpus operators in ``logloom.llm``."""
