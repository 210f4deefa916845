"""Review operators over DataFrames."""
