"""Operators for training-data pipelines.

Nothing else in the package imports this subpackage; ``__spark_entry__.py`` adds
its queries only where it can be imported.
"""
