"""Leases with fencing numbers: one run of a name at a time, and a run that was overtaken writes nothing.

A lease is a numbered file that one writer can create. It ends when its holder releases it or when its time is up; the next one has the
next number, so numbers rise with every holder. A holder shows its number when it publishes (``Estate``), and a number below the
highest that was shown is refused there: a holder that slept through its time cannot overwrite what came after it. Drivers' clocks
only decide when a lease may be taken over; that nobody overwrites anybody follows from the numbers.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .files import Files, numbered


class LeaseLost(RuntimeError):
    """The lease has ended: its time is up, or another holder has taken over."""


@dataclass
class Lease:
    name: str
    holder: str
    number: int
    until: float
    leases: Leases

    def renew(self, seconds: float) -> None:
        """More time, under the same number; LeaseLost where it isn't held any more."""
        self.check()
        self.until = self.leases.clock() + seconds
        turn = len(self.leases.files.names(self.leases.folder(self.name, f"more-{numbered(self.number)}")))
        if not self.leases.files.put_if_absent(self.leases.folder(self.name, f"more-{numbered(self.number)}/{numbered(turn)}"), {"until": self.until}):
            raise LeaseLost(f"{self.name}: another process renews lease {self.number}")
        self.check()

    def check(self) -> None:
        if self.leases.clock() >= self.until:
            raise LeaseLost(f"{self.name}: the time of {self.holder} (lease {self.number}) is up")
        if (last := self.leases.files.last_number(self.leases.folder(self.name))) > self.number:
            raise LeaseLost(f"{self.name}: lease {last} has taken over from {self.number}")

    def release(self) -> None:
        self.leases.files.put_if_absent(self.leases.folder(self.name, f"over-{numbered(self.number)}"), {"holder": self.holder})

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class Leases:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time) -> None:
        self.files, self.clock = Files(spark, path), clock

    def folder(self, name: str, file: str = "") -> str:
        return f"leases/{name}/{file}" if file else f"leases/{name}"

    def acquire(self, name: str, holder: str, seconds: float) -> Lease | None:
        """The lease, or None where another holds it. It doesn't wait."""
        last = self.files.last_number(self.folder(name))
        if last >= 0 and not self._ended(name, last):
            return None
        until = self.clock() + seconds
        if not self.files.put_if_absent(self.folder(name, numbered(last + 1)), {"holder": holder, "until": until}):
            return None  # another came first
        return Lease(name, holder, last + 1, until, self)

    def _ended(self, name: str, number: int) -> bool:
        if self.files.exists(self.folder(name, f"over-{numbered(number)}")):
            return True
        held = self.files.get(self.folder(name, numbered(number)))
        more = self.files.names(self.folder(name, f"more-{numbered(number)}"))
        if more:
            held = self.files.get(self.folder(name, f"more-{numbered(number)}/{more[-1]}"))
        return self.clock() >= held["until"]
