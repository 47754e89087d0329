"""The dialect's front end: tokens, syntax trees, statements."""
