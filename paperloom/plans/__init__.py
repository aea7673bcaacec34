"""Named queries over a data folder and their SQL counterparts."""
