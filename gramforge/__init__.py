"""Dense linear algebra over DataFrames: symmetric solves, inverses, eigenvalues and block-cyclic layouts."""
