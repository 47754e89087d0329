"""Scalar functions of the dialect as Spark SQL text, and the few Arrow functions that built-ins can't express."""
