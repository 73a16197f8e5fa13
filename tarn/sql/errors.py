class DialectError(Exception):
    """A statement or command that cannot be run."""


class ParseError(DialectError):
    pass


class BindError(DialectError):
    pass


class LoadError(DialectError):
    pass
