"""Whole commands: init, backup, commit, abort, restore, prune and cull."""
