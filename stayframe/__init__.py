"""stayframe: Spark jobs that build study cohorts from large event tables."""
