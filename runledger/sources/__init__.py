"""Reading and writing events, raw events, trace exports, dead letters and bundles."""
