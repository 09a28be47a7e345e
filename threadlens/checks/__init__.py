"""Views, queries and SQL for the correctness check."""
