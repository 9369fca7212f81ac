"""Where rows come from and go to: keyed tables of Parquet runs, and registered DataFrames."""
