"""tessera: warehouse pipeline, mapping, lineage and data-quality jobs on Spark.

Every operator is a function from DataFrames to a DataFrame; nothing is
collected to the driver except the loop condition of the lineage closure.
"""

from tessera.params import RunParams

__all__ = ["RunParams"]
__version__ = "0.1.0"
