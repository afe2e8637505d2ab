"""sessionloom: agent-activity analytics and training-data preparation on PySpark."""
