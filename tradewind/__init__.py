"""tradewind: a Spark-native retail lakehouse analytics library."""
