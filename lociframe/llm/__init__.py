"""Text-corpus operators for training-data pipelines, each a Spark DataFrame job."""
