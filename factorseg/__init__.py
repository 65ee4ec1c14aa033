"""factorseg: segmentation of mixed (categorical and numeric) tables on Spark."""
