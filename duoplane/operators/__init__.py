"""DataFrame operators: matching, diffing, discovery, revisions, decisions, lifecycle."""
