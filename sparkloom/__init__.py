"""A PySpark-native analytics engine for geolocated event records: profile, severity, clusters, load, scores, forecasts, plans."""

__version__ = "0.1.0"
