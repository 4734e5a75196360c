"""What a request, a model or a source can fail with."""


class Rejected(ValueError):
    """The request does not fit the model. Raised while binding, before any job runs."""


class InvalidModel(Rejected):
    """The model contradicts itself."""


class StaleRevision(Rejected):
    """The draft was changed by someone else since it was read."""


class SourceFault(RuntimeError):
    """A source cannot be read; the request itself may be fine."""
