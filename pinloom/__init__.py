"""pinloom: search and analysis over pinned source corpora, on Spark DataFrames."""
