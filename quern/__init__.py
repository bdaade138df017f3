"""quern: a semantic analytics engine whose plans are Spark DataFrames."""
