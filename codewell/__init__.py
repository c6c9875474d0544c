"""codewell: codeword retrieval and corpus operators on Spark DataFrames."""
