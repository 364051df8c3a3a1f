"""The one exception a caller has to handle: the question cannot be answered as asked."""


class Refused(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
