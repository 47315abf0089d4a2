"""What can be wrong with an input."""


class DataValidationError(Exception):
    """Base of all input errors."""


class FileNotFoundOrEmptyError(DataValidationError):
    """No such file, or nothing in it."""


class CorruptDataError(DataValidationError):
    """The file can't be read as the expected table."""


class SchemaValidationError(DataValidationError):
    """Columns are missing or have the wrong type."""
