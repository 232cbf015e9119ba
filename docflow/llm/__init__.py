"""Operators of a large-scale training-data pipeline. Nothing else in docflow imports this subpackage."""
