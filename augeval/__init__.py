"""augeval: DataFrame operators for curating, decontaminating and evaluating augmented training data on Spark."""

__version__ = "0.1.0"
