"""Incident analytics on Spark.

Column-parameterised DataFrame operators for tables of located,
time-stamped incidents.  Every operator takes and returns a Spark
``DataFrame`` and is built from Spark SQL expressions, aggregations,
joins and ``pyspark.ml`` stages, so that Catalyst plans the work and the
same code runs on a laptop and on a cluster.
"""

__version__ = "0.1.0"
