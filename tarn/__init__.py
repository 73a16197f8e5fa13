"""A strict SELECT dialect over CSV and Parquet tables, lowered to Spark DataFrames."""
