"""storyloom: feed analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames or Columns; nothing is executed until the caller acts, except in the
few places that say so (connected components and incremental writes).
"""
