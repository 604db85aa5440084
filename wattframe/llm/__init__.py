"""Operators for preparing training text at scale."""

from .memory import return_freed

return_freed()  # also in every worker process that runs a function of this subpackage
