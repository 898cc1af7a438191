"""Analyses of one parsed file that no column expression can express; they run inside the Arrow pass of weftfacts.sources."""
