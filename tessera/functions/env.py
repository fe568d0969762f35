"""``${VAR}`` / ``${VAR:-default}`` expansion and ``${connection.project}`` binding."""

from __future__ import annotations

import os
import re

from tessera.errors import ConfigError

_VAR = re.compile(r"\$\{([^}]*)\}")


def _check_terminated(text: str) -> None:
    start = 0
    while True:
        i = text.find("${", start)
        if i < 0:
            return
        j = text.find("}", i + 2)
        if j < 0:
            raise ConfigError(f"unterminated ${{...}} in {text!r}")
        start = j + 1


def expand(text: str, env: dict[str, str] | None = None) -> str:
    """Expand environment references; an unset variable without default is an error."""
    if text is None:
        return text
    env = os.environ if env is None else env
    _check_terminated(text)

    def sub(m: re.Match) -> str:
        body = m.group(1)
        name, sep, default = body.partition(":-")
        if name in env:
            return env[name]
        if sep:
            return default
        raise ConfigError(f"environment variable {name!r} is unset and has no default")

    return _VAR.sub(sub, text)


def expand_connection(source: str, query: str, project: str | None) -> str:
    """Replace ``${connection.project}``; any other ``${connection.*}`` is refused."""
    _check_terminated(query)
    out = []
    pos = 0
    for m in re.finditer(r"\$\{connection\.([^}]*)\}", query):
        out.append(query[pos : m.start()])
        name = m.group(1)
        if name != "project":
            raise ConfigError(f"source {source!r}: ${{connection.{name}}} is not a supported binding")
        if project is None:
            raise ConfigError(
                f"source {source!r}: ${{connection.project}} does not apply to this connection type"
            )
        out.append(project)
        pos = m.end()
    out.append(query[pos:])
    return "".join(out)
