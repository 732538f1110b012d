"""Multi-step plans: the store, its flushes and its compactions."""
