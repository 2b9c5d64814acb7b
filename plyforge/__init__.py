"""plyforge: game-sequence analytics and training-data preparation on PySpark."""
