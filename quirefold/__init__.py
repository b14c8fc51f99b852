"""Budget-constrained document processing and training-data preparation on Spark DataFrames."""
