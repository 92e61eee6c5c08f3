"""netloom: labelled network-flow dataset construction and audit on Spark."""
