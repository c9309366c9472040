"""Observation tables, interval algebra, ordered sequences and gridded sums as Spark plans."""
