"""The process that a plugin's module runs in: requests on standard input, answers on standard output.

A frame is four bytes of length and that much JSON. The first request holds the module's text
and the memory it may take, each other one a file's text and options; an answer holds tags or
an error. What runs here was fetched from an index, so it may not open files but to import,
start processes, use the network or touch the file system. That keeps mistakes of modules
from the worker; it is no wall against code that sets out to break it.
"""

from __future__ import annotations

import json
import os
import struct
import sys
from typing import BinaryIO

from .base import Options, Source, Tag

#: Audit events refused, by the part before the first dot; ``os.listdir`` and ``open`` are looked at.
REFUSED = frozenset(
    ("ctypes", "ensurepip", "fcntl", "ftplib", "glob", "http", "imaplib", "os", "pathlib", "poplib", "pty", "shutil", "smtplib", "socket", "sqlite3", "subprocess", "syslog", "tempfile", "urllib", "webbrowser")
)


def read_frame(pipe: BinaryIO) -> dict | None:
    head = pipe.read(4)
    if len(head) < 4:
        return None
    size = struct.unpack("<I", head)[0]
    body = pipe.read(size)
    return json.loads(body) if len(body) == size else None


def _bound(memory: int) -> None:
    """``memory`` bytes more than now, few open files, none written."""
    import resource

    with open("/proc/self/statm") as f:
        now = int(f.read().split()[0]) * resource.getpagesize()
    resource.setrlimit(resource.RLIMIT_AS, (now + memory, now + memory))
    resource.setrlimit(resource.RLIMIT_NOFILE, (32, 32))
    resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))


def _guard() -> None:
    roots = tuple({os.path.realpath(p).rstrip("/") + "/" for p in (*sys.path, sys.prefix, sys.base_prefix) if p and p != "/"})
    writes = os.O_WRONLY | os.O_RDWR | os.O_CREAT | os.O_TRUNC | os.O_APPEND
    real = os.path.realpath

    def imports(path) -> bool:
        return isinstance(path, str) and (real(path) + "/").startswith(roots)

    def hook(event: str, args: tuple) -> None:
        if event == "open":
            path, _, flags = args
            allowed = imports(path) and not (flags or 0) & writes
        elif event == "os.listdir":
            allowed = imports(args[0])
        else:
            allowed = event.split(".", 1)[0] not in REFUSED
        if not allowed:
            raise PermissionError(f"a plugin may not do this: {event}")

    sys.addaudithook(hook)


def main() -> None:
    # what the module prints goes nowhere
    requests, answers = os.fdopen(os.dup(0), "rb"), os.fdopen(os.dup(1), "wb")
    nothing = os.open(os.devnull, os.O_RDWR)
    for fd in (0, 1, 2):
        os.dup2(nothing, fd)
    names: dict = {"Tag": Tag}
    while (request := read_frame(requests)) is not None:
        try:
            if "module" in request:
                _bound(request["memory"])
                _guard()
                exec(compile(request["module"], "<plugin>", "exec"), names)
                answer: dict = {"tags": []}
            else:
                options = Options(frozenset(request["kinds"]), frozenset(request["fields"]), request["qualified"], request["file_scope"], request["file_name"])
                answer = {"tags": [[t.name, t.row, t.kind, [list(f) for f in t.fields], t.end] for t in names["extract"](Source(request["text"]), options)]}
            body = json.dumps(answer)  # what is no text or number fails here, inside the try
        except BaseException as e:  # noqa: BLE001
            body = json.dumps({"error": f"{type(e).__name__}: {str(e)[:500]}"})
        data = body.encode()
        answers.write(struct.pack("<I", len(data)) + data)
        answers.flush()
