"""A PySpark-native engine for runs of homozygosity and large-scale event and record data."""

__version__ = "0.1.0"
