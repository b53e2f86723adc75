"""corpusprep: Spark jobs that prepare, sample and evaluate text corpora."""
