"""Lakehouse lineage and change impact, expressed as Spark jobs over tables."""
