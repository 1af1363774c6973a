"""Spark-native content clearance: fingerprints, similarity joins, routing, dedup, governance and lineage as DataFrame plans."""
