"""driftmap: neighbour-preserving maps of vectors, as Spark DataFrame operators."""
