"""Versioned evolution of Spark datasets: change operations, validation, schema diffs and a revision graph."""
