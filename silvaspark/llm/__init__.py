"""Operators for large text corpora. Nothing else in the library imports this subpackage.

Every operator takes and returns DataFrames, and works on executors that share
only ``spark.checkpoint.dir``, the warehouse and the inputs.
"""
