"""Panel analytics on Spark: entity-by-period tables, snapshots, squads, metrics."""
