"""chronoweave: event-train, time-series and template analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
