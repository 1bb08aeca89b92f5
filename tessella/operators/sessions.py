"""Named connections and context variables."""

from __future__ import annotations

from ..errors import NotThere, QueryError
from ..functions.text import matches_name

#: Variables that every context has, and the one that no one may read back.
CONTEXT = {"WILDCARD_ALL": "*", "WILDCARD_ONE": "?", "WILDCARD_ESC": "\\", "VALUEMATRIX_MODE": "CALCULATED"}
HIDDEN = "PASSWORD"


class Context:
    """Variables of a session, asked for by patterns."""

    def __init__(self, values: dict[str, str] | None = None):
        self.values = CONTEXT | (values or {})

    def get(self, pattern: str = "*") -> dict[str, str]:
        return {n: v for n, v in sorted(self.values.items()) if matches_name(n, pattern)}

    def set(self, name: str, value: str) -> None:
        self.values[name] = value

    def set_all(self, values: dict[str, str]) -> None:
        self.values |= values


class Connections:
    """Parameters of stores by name; a changed connection is opened anew when it is next used."""

    def __init__(self, opener=None):
        self.parameters: dict[str, dict[str, str]] = {}
        self.opener, self.sessions = opener, {}

    def create(self, name: str, parameters: dict[str, str]) -> None:
        if name in self.parameters:
            raise QueryError(f"there is a connection {name}")
        self.parameters[name] = dict(parameters)

    def update(self, name: str, parameters: dict[str, str]) -> None:
        """Sets the given parameters, all of them; a connection that is not there is created."""
        self.close(name)
        self.parameters.setdefault(name, {}).update(parameters)

    def put_all(self, connections: dict[str, dict[str, str]]) -> None:
        for name, parameters in connections.items():
            self.update(name, parameters)

    def delete(self, name: str) -> None:
        self.get(name)
        self.close(name)
        del self.parameters[name]

    def names(self) -> list[str]:
        return sorted(self.parameters)

    def get(self, name: str) -> dict[str, str]:
        if name not in self.parameters:
            raise NotThere(f"there is no connection {name}")
        return {k: v for k, v in self.parameters[name].items() if k != HIDDEN}

    def session(self, name: str):
        """What the opener makes of a connection's parameters; made once."""
        self.get(name)
        if name not in self.sessions:
            self.sessions[name] = self.opener(dict(self.parameters[name]))
        return self.sessions[name]

    def close(self, name: str) -> None:
        self.sessions.pop(name, None)
