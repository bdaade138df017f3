"""Errors carry a code and say what is wrong."""


class QuernError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class ModelError(QuernError):
    """The model can't be right."""


class RequestError(QuernError):
    """The model can't answer the request."""
