"""Training-data operators: each module holds one operator and its tests live in ``tests/llm``."""
