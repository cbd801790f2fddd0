"""Plan-shape helpers shared by operators."""
