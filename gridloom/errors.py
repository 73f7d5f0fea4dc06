"""The package's error: a ``code`` says what went wrong."""


class SheetError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
