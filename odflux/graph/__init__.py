"""Flow-graph operators on edge tables, all snapshots of a table at once."""
