"""Computer-activity analytics and corpus operators on Spark."""
