"""NumPy kernels that run inside one group: a tile, a day or a window."""
