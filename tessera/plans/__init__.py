"""Views over the synthetic tables and the queries on them."""
