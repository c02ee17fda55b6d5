"""Training-data operators: extraction, deduplication, decontamination,
secret scans, sharding, scoring and tokenisation, each as a Spark job."""
