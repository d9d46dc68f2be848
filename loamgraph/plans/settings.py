"""Settings kept as a small JSON file."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

# Ports that other programs commonly use.
RESERVED_PORTS = frozenset((3000, 5173, 5174, 5432, 6333, 6334, 8080, 8083))


@dataclass
class Endpoint:
    url: str = ""
    api_key: str = ""
    model: str = ""


@dataclass
class Settings:
    welcome_seen: bool = False
    endpoint: Endpoint | None = None
    store_port: int = 0
    embed_port: int = 0
    embed_model: str = "hashing"
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, folder: str) -> Settings:
        """The stored settings; the defaults where there are none or they cannot be read."""
        try:
            with open(os.path.join(folder, "settings.json"), encoding="utf-8") as file:
                raw = json.load(file)
            known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
            if known.get("endpoint"):
                known["endpoint"] = Endpoint(**known["endpoint"])
            return cls(**known)
        except (OSError, ValueError, TypeError):
            return cls()

    def save(self, folder: str) -> None:
        """Write beside the file and rename, so that a reader never sees half of it."""
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, "settings.json")
        with open(path + ".tmp", "w", encoding="utf-8") as file:
            json.dump(asdict(self), file, indent=2)
        os.replace(path + ".tmp", path)

    def has_endpoint(self) -> bool:
        return bool(self.endpoint and self.endpoint.url.strip())

    def with_ports(self, store_port: int, embed_port: int) -> Settings:
        """Take new ports; 0 means any, a reserved one is refused."""
        for port in (store_port, embed_port):
            if port in RESERVED_PORTS:
                raise ValueError(f"port {port} is reserved")
        self.store_port, self.embed_port = store_port, embed_port
        return self
