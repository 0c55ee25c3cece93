"""scholia: relational analysis of mathematical manuscripts on Spark."""
