"""leadlake: company-registry and sales-lead analytics as ordinary PySpark jobs."""

__version__ = "0.1.0"
