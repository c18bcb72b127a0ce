"""Plans shared by operators: written tables and connected components."""
