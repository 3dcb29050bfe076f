"""Column builders and array kernels: vectors, hashes, paths, pixels."""
