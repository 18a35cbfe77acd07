"""corvane: a Spark-native engine for analysing, searching and preparing text and source corpora."""
