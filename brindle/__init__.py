"""brindle: a Spark-native engine for curating labelled data sets and judging multi-stage classifiers."""

__version__ = "0.1.0"
