"""histloom: software-history analytics and training-data preparation on Spark."""
