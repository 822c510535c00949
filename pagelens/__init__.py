"""PySpark operators for machine traffic and machine-readable web pages."""
