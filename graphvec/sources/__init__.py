"""Sources: parquet test tables and the text/CSV/parquet layouts of the
engine this library re-creates (edge lists, adjacency matrices, vector
files, label lists, visit histograms, saved models)."""
