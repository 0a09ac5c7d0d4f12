"""Trees, compiling, and the plans that trees become."""
