"""Score documents and match them at corpus scale with Spark DataFrames."""
