"""linkrisk: exposure-aware screening of network segments as Spark DataFrame jobs."""
