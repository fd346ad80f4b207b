"""Training-data operators: ten first-class components and their queries.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers
its queries only when it can be imported.
"""
