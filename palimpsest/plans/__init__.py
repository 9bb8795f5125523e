"""Month pruning, declared tracking and policies."""
