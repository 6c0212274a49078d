"""Where encryption keys come from. A key service plugs in by implementing ``KeyProvider``."""

from __future__ import annotations

import base64
import os
from abc import ABC, abstractmethod
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

KEY_VARIABLE = "COLDLAKE_KEY"


class KeyProvider(ABC):
    @abstractmethod
    def key(self) -> bytes:
        """16, 24 or 32 bytes."""


class StaticKey(KeyProvider):
    def __init__(self, key: bytes):
        self._key = bytes(key)

    def key(self) -> bytes:
        return self._key


class EnvironmentKey(KeyProvider):
    """A base64 key in an environment variable of the driver."""

    def __init__(self, variable: str = KEY_VARIABLE):
        self.variable = variable

    def key(self) -> bytes:
        text = os.environ.get(self.variable)
        if not text:
            raise KeyError(f"{self.variable} is not set")
        return base64.b64decode(text)


class FileKey(KeyProvider):
    """A base64 key in a file that only its owner can read."""

    def __init__(self, path: str):
        self.path = path

    def key(self) -> bytes:
        with open(self.path, encoding="ascii") as file:
            return base64.b64decode(file.read())

    @classmethod
    def create(cls, path: str, size: int = 32) -> FileKey:
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as file:
            file.write(base64.b64encode(generate_key(size)).decode())
        return cls(path)


class KeyService(ABC):
    """A service that keeps a master key and never shows it."""

    @abstractmethod
    def wrap(self, key: bytes) -> bytes:
        """A data key, encrypted with the master key."""

    @abstractmethod
    def unwrap(self, wrapped: bytes) -> bytes:
        """The inverse of ``wrap``; raises if ``wrapped`` was changed."""


class SparkKeyService(KeyService):
    """A master key that the driver holds, used through Spark's own AES-GCM."""

    def __init__(self, spark: SparkSession, master: bytes | KeyProvider):
        self._spark, self._master = spark, master

    def _apply(self, function: Callable[..., Column], data: bytes) -> bytes:
        # the keys come as a local row: plans name its columns and never show them
        row = pa.table({"data": pa.array([data], pa.binary()), "key": pa.array([resolve_key(self._master)], pa.binary())})
        return bytes(self._spark.createDataFrame(row).select(function("data", "key", F.lit("GCM"))).first()[0])

    def wrap(self, key: bytes) -> bytes:
        return self._apply(F.aes_encrypt, key)

    def unwrap(self, wrapped: bytes) -> bytes:
        return self._apply(F.aes_decrypt, wrapped)


class EnvelopeKey(KeyProvider):
    """A data key that is kept wrapped; the service unwraps it once, when it is first used."""

    def __init__(self, service: KeyService, wrapped: bytes):
        self.service, self.wrapped, self._key = service, bytes(wrapped), None

    @classmethod
    def create(cls, service: KeyService, size: int = 32) -> EnvelopeKey:
        return cls(service, service.wrap(generate_key(size)))

    def key(self) -> bytes:
        if self._key is None:
            self._key = self.service.unwrap(self.wrapped)
        return self._key


def generate_key(size: int = 32) -> bytes:
    return os.urandom(size)


def resolve_key(key: bytes | KeyProvider | None) -> bytes | None:
    return key.key() if isinstance(key, KeyProvider) else key
