"""A PySpark-native engine for inspecting, cleaning, reshaping and shipping training data for language models."""

__version__ = "0.1.0"
