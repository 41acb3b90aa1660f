"""Clients over TCP: statements in as text, each answered by its result as text or JSON and a zero byte.

Every connection has a session, so its own transaction and knobs; what one commits the others see.
"""

from __future__ import annotations

import socketserver

from pyspark.sql import SparkSession

from brindle.session import Session

END = b"\0"


def statements(text: str) -> tuple[list[str], str]:
    """The whole statements of a text, and what is left after the last semicolon that no quotes enclose."""
    out, at, quoted = [], 0, False
    for i, c in enumerate(text):
        quoted ^= c == "'"
        if c == ";" and not quoted:
            out.append(text[at : i + 1].strip())
            at = i + 1
    return out, text[at:]


def serve(spark: SparkSession, root: str, port: int = 8765, host: str = "127.0.0.1", as_json: bool = False) -> socketserver.ThreadingTCPServer:
    """A server that waits for its serve_forever(); host and port are those it listens at."""

    class Client(socketserver.BaseRequestHandler):
        def handle(self) -> None:
            session, held = Session(spark, root), b""
            while not session.closed and (got := self.request.recv(1 << 16)):
                held += got.replace(END, b"")
                whole, rest = statements(held.decode("utf-8", "surrogateescape"))
                held = rest.encode("utf-8", "surrogateescape")
                for text in whole:
                    self.request.sendall(session.shown(text, as_json).encode() + END)
            if session.transaction:  # the client is gone
                session.execute("ROLLBACK;")

    class Server(socketserver.ThreadingTCPServer):
        allow_reuse_address = daemon_threads = True

    return Server((host, port), Client)
