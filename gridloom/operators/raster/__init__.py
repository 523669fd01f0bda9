"""Raster operators: an image is a row (image_id, w, h, v) with its grey levels row by row in v.

Point operators are Column expressions over v. Neighbourhood operators and iterative ones are NumPy kernels on stacks of
images of one size, run on Arrow batches: higher-order functions would interpret every tap of every pixel.
"""
