"""lexloom: keyword and relation mining over text corpora, on Spark DataFrames."""
