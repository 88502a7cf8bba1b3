"""opsloom: operations analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is pulled to
the driver except metadata whose size is bounded by the schema or by the number
of partitions.
"""
