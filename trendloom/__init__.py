"""Discovery analytics on Spark: feeds, facets, trends, scoring and text rules as DataFrames."""
