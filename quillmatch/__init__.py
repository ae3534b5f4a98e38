"""Record linkage between document sets, and operators for text corpora, on Spark."""
