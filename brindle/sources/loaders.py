"""Connectors for storage that Spark doesn't read itself, and one for a shared folder.

A connector is chosen by its can_handle(); the first registered one wins. Without one, Spark's own sources serve.
"""

from __future__ import annotations

import os
import shutil
from abc import ABC, abstractmethod
from urllib.parse import unquote, urlparse


class FileLoader(ABC):
    """A connector. list_files, init_save and mark_saved run on the driver, load_file and save_file on executors."""

    @abstractmethod
    def can_handle(self, uri: str) -> bool:
        """Whether this connector serves uri."""

    @abstractmethod
    def list_files(self, uri: str, recursive: bool = False) -> list[str]:
        """The files in a folder, or the file itself; hidden and empty ones too."""

    @abstractmethod
    def load_file(self, uri: str) -> bytes:
        """A listed file's bytes."""

    @abstractmethod
    def init_save(self, uri: str, overwrite: bool = True) -> None:
        """Makes an empty folder ready and marks it as being written. Without overwrite an existing one is an error."""

    @abstractmethod
    def save_file(self, uri: str, name: str, data: bytes) -> None:
        """Writes one file of the folder whole: a task that runs again leaves the same."""

    @abstractmethod
    def mark_saved(self, uri: str) -> None:
        """Marks the folder as complete."""


class SharedFolder(FileLoader):
    """A folder that the driver and all executors share; paths and file: URIs."""

    WRITING, DONE = ".writing", ".success"

    def can_handle(self, uri: str) -> bool:
        return urlparse(uri).scheme in ("", "file")

    @staticmethod
    def path(uri: str) -> str:
        parsed = urlparse(uri)
        return os.path.abspath(unquote(parsed.path) if parsed.scheme == "file" else uri)

    def list_files(self, uri: str, recursive: bool = False) -> list[str]:
        top = self.path(uri)
        if os.path.isfile(top):
            return [top]
        if recursive:
            return sorted(os.path.join(folder, f) for folder, _, files in os.walk(top) for f in files)
        return sorted(e.path for e in os.scandir(top) if e.is_file())

    def load_file(self, uri: str) -> bytes:
        with open(self.path(uri), "rb") as f:
            return f.read()

    def init_save(self, uri: str, overwrite: bool = True) -> None:
        top = self.path(uri)
        if os.path.exists(top):
            if not overwrite:
                raise FileExistsError(f"{top} exists")
            shutil.rmtree(top)
        os.makedirs(top)
        open(os.path.join(top, self.WRITING), "wb").close()

    def save_file(self, uri: str, name: str, data: bytes) -> None:
        at = os.path.join(self.path(uri), name)
        with open(part := f"{at}.{os.getpid()}.part", "wb") as f:
            f.write(data)
        os.replace(part, at)

    def mark_saved(self, uri: str) -> None:
        top = self.path(uri)
        os.replace(os.path.join(top, self.WRITING), os.path.join(top, self.DONE))


class Loaders:
    """The registered connectors, in order."""

    def __init__(self):
        self._loaders: list[FileLoader] = []

    def register(self, loader: FileLoader) -> None:
        self._loaders.append(loader)

    def get(self, uri: str) -> FileLoader | None:
        return next((x for x in self._loaders if x.can_handle(uri)), None)
