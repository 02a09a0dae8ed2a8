"""Training-data operators. ``docscope.llm.queries`` registers them."""
