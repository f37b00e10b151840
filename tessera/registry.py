"""The registry of remote tables: which logical names stand for which tables, and where."""

from __future__ import annotations

import dataclasses
import threading


class RegistryError(ValueError):
    pass


class CatalogError(ValueError):
    pass


@dataclasses.dataclass(frozen=True)
class Mapping:
    server: str
    target: str
    distributed: bool = True


class Registry:
    def __init__(self):
        self.tables: dict[str, Mapping] = {}
        self.lock = threading.Lock()

    def register(self, local: str, target: str, server: str = "local") -> None:
        with self.lock:
            if local in self.tables:
                raise RegistryError(f"Failed to register table {local} because it's already registered!")
            self.tables[local] = Mapping(server, target)

    def unregister(self, local: str) -> None:
        with self.lock:
            if self.tables.pop(local, None) is None:
                raise RegistryError(f"Failed to unregister table {local} because it hasn't been registered!")

    def discard(self, local: str) -> None:
        with self.lock:
            self.tables.pop(local, None)

    def rename(self, old: str, new: str) -> None:
        """Moves what stands for ``old``, under its own name or as a target, to ``new``."""
        with self.lock:
            for local, mapping in list(self.tables.items()):
                if mapping.target == old:
                    self.tables[local] = dataclasses.replace(mapping, target=new)
            if old in self.tables:
                self.tables[new] = self.tables.pop(old)

    def resolve(self, name: str) -> str:
        """The name of the table that ``name`` stands for; itself if it isn't registered."""
        with self.lock:
            return self.tables[name].target if name in self.tables else name

    def is_remote(self, name: str) -> bool:
        with self.lock:
            return name in self.tables
