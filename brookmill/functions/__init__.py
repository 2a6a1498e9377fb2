"""Column-level functions; every one returns a ``Column`` and stays inside the JVM
unless its docstring says otherwise."""
