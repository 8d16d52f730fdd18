"""Street-view blind-zone analytics as lazy Spark plans."""
