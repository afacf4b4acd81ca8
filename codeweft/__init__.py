"""codeweft: code-graph analytics and training-data preparation as Spark plans."""
