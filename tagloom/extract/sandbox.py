"""Plugins' modules in processes of their own, one a module and task, with bounds on time and memory.

A module that raises, hangs, dies or sends nonsense fails for the file it was given; the next
file finds a new process.
"""

from __future__ import annotations

import json
import os
import select
import struct
import subprocess
import sys
import time
from dataclasses import dataclass
from typing import BinaryIO

from .base import Options, Source, Tag


class PluginFailed(Exception):
    """What a module could not do for one file."""


@dataclass(frozen=True)
class Limits:
    """For one file: seconds, bytes of memory above what an idle process takes, bytes of an answer."""

    seconds: float = 30.0
    memory: int = 512 << 20
    answer: int = 256 << 20


class PluginProcess:
    def __init__(self, module: str, limits: Limits = Limits()):
        self.module, self.limits, self.process = module, limits, None

    def _start(self) -> None:
        env = {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p), "PYTHONDONTWRITEBYTECODE": "1", "LC_ALL": "C.UTF-8"}
        # -S: our own path is given, and what site packages run at a start takes longer than all else
        command = [sys.executable, "-S", "-c", "from tagloom.extract.plugin_child import main; main()"]
        self.process = subprocess.Popen(command, bufsize=0, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, cwd="/")
        os.set_blocking(self.process.stdin.fileno(), False)
        self._ask({"module": self.module, "memory": self.limits.memory})

    def close(self) -> None:
        process, self.process = self.process, None
        if process is not None:
            process.kill()
            process.stdout.close()
            try:
                process.stdin.close()
            except OSError:
                pass  # a request that the process did not live to read
            process.wait()

    def _wait(self, pipe: BinaryIO, event: int, until: float) -> int:
        """The descriptor of a pipe, once it is ready; TimeoutError if it is not by then."""
        ready = select.poll()
        ready.register(pipe, event)
        if not ready.poll(max(0.0, until - time.monotonic()) * 1000):
            raise TimeoutError
        return pipe.fileno()

    def _send(self, data: bytes, until: float) -> None:
        left = memoryview(data)
        while left:
            left = left[os.write(self._wait(self.process.stdin, select.POLLOUT, until), left) :]

    def _exactly(self, size: int, until: float) -> bytes:
        data = bytearray()
        while len(data) < size:
            piece = os.read(self._wait(self.process.stdout, select.POLLIN, until), min(size - len(data), 1 << 20))
            if not piece:
                raise EOFError
            data += piece
        return bytes(data)

    def _ask(self, request: dict) -> list:
        until = time.monotonic() + self.limits.seconds
        try:
            body = json.dumps(request).encode()
            self._send(struct.pack("<I", len(body)) + body, until)
            size = struct.unpack("<I", self._exactly(4, until))[0]
            if size > self.limits.answer:
                raise ValueError("its answer is too large")
            answer = json.loads(self._exactly(size, until))
            if "error" in answer:
                if "module" in request:
                    self.close()
                raise PluginFailed(answer["error"])
            return answer["tags"]
        except TimeoutError as e:
            self.close()
            raise PluginFailed(f"took more than {self.limits.seconds:g} s") from e
        except (OSError, EOFError) as e:
            self.close()
            raise PluginFailed("its process ended") from e
        except (ValueError, KeyError, TypeError) as e:
            self.close()
            raise PluginFailed(str(e)) from e

    def extract(self, source: Source, options: Options) -> list[Tag]:
        """The module's tags of a source; PluginFailed for all that goes wrong in it."""
        if self.process is None:
            self._start()
        request = {"text": source.text, "kinds": sorted(options.kinds), "fields": sorted(options.fields), "qualified": options.qualified, "file_scope": options.file_scope, "file_name": options.file_name}
        out = []
        for row in self._ask(request):
            match row:
                case [str(name), int(at), (str() | None) as kind, list(fields), (int() | None) as end] if at >= 0 and all(isinstance(f, list) and len(f) == 2 and all(isinstance(x, str) for x in f) for f in fields):
                    out.append(Tag(name, at, kind, [(a, b) for a, b in fields], end))
                case _:
                    raise PluginFailed(f"no tag: {str(row)[:200]}")
        return out


_running: dict[tuple[str, Limits], PluginProcess] = {}


def process_of(module: str, limits: Limits) -> PluginProcess:
    """The process of a module in this task."""
    return _running.setdefault((module, limits), PluginProcess(module, limits))


def close_all() -> None:
    while _running:
        _running.popitem()[1].close()
