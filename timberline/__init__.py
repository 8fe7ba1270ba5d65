"""Timberline: forest-road analytics expressed as Spark DataFrame plans."""
