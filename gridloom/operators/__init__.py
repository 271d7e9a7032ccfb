"""DataFrame operators over boxes, grids, recognised words, log records and pixel relations."""
