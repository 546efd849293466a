"""Connected components, shared with the corridor operators."""

from fieldsift.operators.components import components  # noqa: F401
