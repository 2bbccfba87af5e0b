"""Names of remote databases: scheme://user:password@host:port/database?name=value&..."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qsl, unquote, urlsplit

SCHEMES = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "derby": "derby", "parquet": "parquet"}


@dataclass(frozen=True)
class Dsn:
    """The parts of a data source name."""

    kind: str
    user: str | None
    password: str | None
    host: str | None
    port: int | None
    database: str
    options: tuple[tuple[str, str], ...] = ()

    @classmethod
    def parse(cls, text: str) -> Dsn:
        """Read a DSN; an unknown scheme is an error."""
        parts = urlsplit(text)
        if parts.scheme not in SCHEMES:
            raise ValueError(f"unknown database kind {parts.scheme!r}")
        kind = SCHEMES[parts.scheme]
        if kind == "parquet":
            return cls(kind, None, None, None, None, parts.path)
        if kind == "derby":
            return cls(kind, None, None, None, None, text.split("://", 1)[1].split("?")[0])
        if not parts.hostname or not parts.path.strip("/"):
            raise ValueError("a host and a database are needed")
        return cls(kind, unquote(parts.username) if parts.username else None, unquote(parts.password) if parts.password else None, parts.hostname, parts.port, parts.path.lstrip("/"), tuple(parse_qsl(parts.query)))

    def jdbc(self) -> tuple[str, dict[str, str]]:
        """JDBC URL and connection properties; the password is in the properties only."""
        if self.kind == "derby":
            return f"jdbc:derby:{self.database}", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
        port = f":{self.port}" if self.port else ""
        query = "?" + "&".join(f"{k}={v}" for k, v in self.options) if self.options else ""
        held = {"user": self.user, "password": self.password}
        return f"jdbc:{self.kind}://{self.host}{port}/{self.database}{query}", {k: v for k, v in held.items() if v is not None}

    def __str__(self) -> str:
        """Without the password."""
        return f"{self.kind}://{self.user or ''}@{self.host or ''}/{self.database}"
