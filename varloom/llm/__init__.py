"""Training-data operators: each module holds one operator, its registered query and, where SQL can express it, the SQL."""
