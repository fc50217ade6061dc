"""lexisweave: full-text search, corpus analytics and corpus curation on Spark DataFrames."""
