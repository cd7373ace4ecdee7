"""Spark-native analytics for conversations: redaction, causal clocks, consensus, shards and service levels."""
