"""Column functions on grids, dates and values."""
