"""Source-corpus ingest, vector retrieval and field lineage on Spark DataFrames."""
