"""Client-data quality, effect measurement and segmentation on Spark DataFrames."""
