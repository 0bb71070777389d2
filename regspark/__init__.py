"""regspark: taxpayer-id (PAN) and registration (GSTIN) analytics on Spark.

Every operator takes and returns DataFrames; nothing is collected to the driver
except header names (schema inspection) and a handful of one-row aggregates.
"""

from regspark.session import get_spark, scratch_path, AS_OF

__all__ = ["get_spark", "scratch_path", "AS_OF"]
