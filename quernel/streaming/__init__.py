"""Reserved for streaming sources; the dialect has no streaming statements."""
