"""The sales feed made from the test tables, its queries and their oracle SQL."""
