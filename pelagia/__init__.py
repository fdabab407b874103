"""pelagia: a Spark-native query engine for lakes of tabular and gridded files."""

__version__ = "0.1.0"
