"""Daily-bar panel analytics and training-data operators on Spark."""
