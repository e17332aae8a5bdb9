"""Errors that the library raises on purpose."""


class RatioscopeError(Exception):
    """Any of them."""


class ConfigError(RatioscopeError):
    """A configuration that breaks a rule; the message names the field."""


class SyntheticError(RatioscopeError):
    """Synthetic data that can't be made as asked."""


class BundleError(RatioscopeError):
    """A folder that isn't a readable bundle."""


class ProfilingError(RatioscopeError):
    """A series that can't be profiled."""


class IngestError(RatioscopeError):
    """A raw file that doesn't follow its format."""
