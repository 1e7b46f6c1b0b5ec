"""Spark-native lossless sequence analytics: signals, codecs and similarity as DataFrame operators."""
