"""Errors for bad calls. Bad rows go to error tables instead."""


class SourceTreeError(ValueError):
    """There is no folder to read source files from."""


class CheckpointError(RuntimeError):
    """No shared checkpoint folder is set on a cluster session."""
