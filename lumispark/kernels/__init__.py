"""Array kernels in numpy, applied to one stack or plane at a time."""
