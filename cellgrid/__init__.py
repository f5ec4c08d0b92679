"""cellgrid: queries over huge, sparse, N-dimensional integer grids on PySpark."""
