"""Table operations: DataFrame in, DataFrame out."""
