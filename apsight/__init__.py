"""apsight: Wi-Fi access-point sighting analytics on Spark.

Every operator takes and returns DataFrames; nothing is collected to the driver
except small summaries whose size is bounded by a category count (never by rows).
"""

__version__ = "0.1.0"
