"""Training-data operators: each module is one operator, ``queries`` applies them to the
provided tables. Nothing outside this folder imports it."""
