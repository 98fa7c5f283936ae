"""daymark: user-behaviour analytics over signup-relative day windows, on Spark DataFrames."""
