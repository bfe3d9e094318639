"""isoloom: transcript-structure analytics expressed as Spark DataFrame jobs."""
