"""tallyloom: revenue-integrity and corpus operators as lazy Spark DataFrames."""
