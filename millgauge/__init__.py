"""millgauge: property-transaction analytics as PySpark DataFrame operators.

Sub-packages
------------
functions  Column -> Column expressions (cleaning, bands, geohash, planar geometry)
operators  DataFrame -> DataFrame operators (ranks, quantiles, joins, panels, spatial)
sources    readers and writers (delimited text, GeoJSON, staged parquet, exports)
plans      the end-to-end pipelines composed from the above
"""

__version__ = "0.1.0"
