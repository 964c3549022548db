"""tremolo: Spark-native analytics over machine vibration readings.

Layout:
  sources/    loaders for readings, questions, chat logs, incidents and static dimensions
  functions/  column expressions (level banding, text extraction, vector math)
  operators/  DataFrame operators (catalogue aggregates, sequences, vectors, anomaly, chats)
  plans/      multi-operator plans (question routing and batch answering)
  streaming/  the daily rollup as a Structured Streaming aggregation
"""

__all__ = ["session"]
