"""Errors a caller can act on."""


class SievelineError(Exception):
    """Base class of every error raised on purpose by this package."""


class LoadError(SievelineError):
    """A source cannot be read: missing, wrong type, badly encoded or malformed."""


class ValidationError(SievelineError):
    """A table was read but its shape cannot be profiled or cleaned."""


class OptionsError(SievelineError):
    """An option is unknown or outside its domain."""


class PlanError(SievelineError):
    """A cleaning plan cannot be fitted to, or applied on, the given table."""
