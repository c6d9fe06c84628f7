"""A Spark-first engine for k-mer indexing of sequence collections and for corpus preparation."""
