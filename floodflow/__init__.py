"""floodflow: flood relocation and displaced-population reporting on PySpark.

Every public function maps DataFrames to DataFrames; nothing collects rows to
the driver except single scalars (bounds, counts) that steer a plan.
"""

__version__ = "0.1.0"
