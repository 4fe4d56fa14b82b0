"""Conversation memory as Spark jobs: DataFrame in, DataFrame out."""
