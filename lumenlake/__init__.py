"""lumenlake: a PySpark-native analytics engine for video-frame embeddings and media catalogs.

Every operator takes DataFrames and returns a DataFrame; the plan stays declarative so that
Catalyst and AQE choose the physical strategy.
"""

__version__ = "0.1.0"
