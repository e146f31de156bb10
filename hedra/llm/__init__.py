"""Training-data operators: each module is one operator with a general interface; queries.py applies them to the tables."""
