"""Spark-native text preprocessing: tokens, lexical attributes, vocabularies, encodings and language-model batches."""
