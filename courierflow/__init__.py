"""Delivery-operations analytics on PySpark.

Every public function takes and returns Spark DataFrames (or Columns), so jobs
are composed with ``df.transform(...)`` and planned as a whole by Catalyst.
"""

__version__ = "0.1.0"
