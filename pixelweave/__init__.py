"""pixelweave: contact matrices and their analysis as Spark DataFrames."""
