"""Nothing here: the engine is batch-only, as its feature set asks for no stream operator."""
