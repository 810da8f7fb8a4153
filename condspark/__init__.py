"""Analytics over C and C++ source with conditional compilation, as DataFrames."""
