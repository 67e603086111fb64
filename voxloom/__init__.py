"""Analytics over chunked n-dimensional tensors and their JSON metadata, on Spark DataFrames."""
