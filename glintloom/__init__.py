"""Point-localization analytics and training-data preparation on Spark DataFrames."""
