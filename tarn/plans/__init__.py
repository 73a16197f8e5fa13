"""The queries that cover the dialect, on the driver's tables."""
