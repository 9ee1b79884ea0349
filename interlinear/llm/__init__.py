"""Training-data operators: each module is one operator with its own interface.

``queries`` registers one query per operator plus the pipeline; nothing else
in the library imports this subpackage.
"""
