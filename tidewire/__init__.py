"""Traffic-rule analytics and corpus processing on Spark."""

__version__ = "0.1.0"
