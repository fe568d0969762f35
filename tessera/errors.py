"""Error types raised by the engine. Each check fails with one clear message."""


class TesseraError(Exception):
    """Base class for every engine error."""


class ConfigError(TesseraError):
    """A product definition is invalid (resolve-time)."""


class GuardError(TesseraError):
    """A materialisation guard refused a staged delta (null key, duplicate key, drift)."""


class VerifyError(TesseraError):
    """The produced data does not satisfy the declared interface."""


class StoreError(TesseraError):
    """Snapshot store problem: missing version, commit collision, bad pointer."""


class ReadError(TesseraError):
    """A closed-read request is outside the grammar (unknown parameter, bad limit)."""
