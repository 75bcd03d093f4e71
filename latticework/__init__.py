"""latticework: data-dependency discovery on Spark DataFrames."""
