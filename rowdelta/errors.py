"""Exceptions of the package."""


class RowDeltaError(Exception):
    """Base of all."""


class InvalidInputError(RowDeltaError, ValueError):
    """An argument or an input that an operation cannot work with."""


class KeyExtractionError(RowDeltaError):
    """A key names something that the rows do not have."""


class NormalizationError(RowDeltaError):
    """A normaliser failed on the columns that it was given."""


class ComparatorError(RowDeltaError):
    """A custom comparison failed."""


class UnsupportedFormatError(RowDeltaError):
    """A file format that is not known here."""


class MissingOptionalDependencyError(RowDeltaError):
    """An optional package is needed and absent."""


class CorruptedInputError(RowDeltaError):
    """A file that does not hold what its format promises."""


class DiskLimitExceededError(RowDeltaError):
    """An output outgrew its limit."""


class TempStorageError(RowDeltaError):
    """Temporary storage could not be written or read."""
