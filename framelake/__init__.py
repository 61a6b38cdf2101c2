"""framelake: Spark-native analytics over media containers, bitstreams and text corpora."""

__version__ = "0.1.0"
