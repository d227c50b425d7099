"""Graph retrieval and analytics over entity/triple tables, written for Spark."""
