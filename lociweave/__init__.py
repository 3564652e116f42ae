"""Population-genetics analyses of microbial communities as Spark DataFrame operators."""
