"""Operators put together: knowledge-base build, index build, batches of questions, evaluation grids."""
