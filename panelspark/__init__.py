"""panelspark - evaluation of panel time series on Spark.

Every public function takes and returns DataFrames (or Columns) and can be
used with ``df.transform``.  Key and value columns are parameters.
"""
