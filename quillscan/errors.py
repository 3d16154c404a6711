"""Errors, by what went wrong."""


class QuillscanError(Exception):
    """Any error of this package."""


class ParseError(QuillscanError): ...
class PlaybookError(QuillscanError): ...
class InvalidRuleError(PlaybookError): ...
class ConfigurationError(QuillscanError): ...
class CheckpointError(QuillscanError): ...
class NotSupportedError(QuillscanError): ...
