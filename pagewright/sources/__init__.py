"""Files of an archive as DataFrames."""
