"""lodestone: a Spark-native engine for ingesting, chunking, searching and reporting on document corpora."""
