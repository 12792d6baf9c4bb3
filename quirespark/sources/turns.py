"""Turns for requests to servers that want to be asked slowly, shared by all executors.

The driver hands out turns, one an address at a time, each a while after the one before; whoever asks waits
for its own.  A task that runs again asks again and gets a later turn, so that the distance holds whatever
fails, and a turn that is given up costs its while and no more.
"""

from __future__ import annotations

import json
import math
import socket
import socketserver
import threading
import time

from pyspark.sql import SparkSession


class Turns:
    """When each address may be asked next."""

    def __init__(self, clock=time.monotonic):
        self.clock, self.lock, self.next = clock, threading.Lock(), {}

    def take(self, address: str, delay: float) -> float:
        """Seconds to wait for the next turn, which is thereby taken."""
        with self.lock:
            now = self.clock()
            turn = max(now, self.next.get(address, -math.inf))
            self.next[address] = turn + delay
            return turn - now


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        for line in self.rfile:
            asked = json.loads(line)
            wait = self.server.turns.take(asked["address"], asked["delay"]) if asked["key"] == self.server.key else -1
            self.wfile.write(f"{wait}\n".encode())


class _Server(socketserver.ThreadingTCPServer):
    daemon_threads, allow_reuse_address = True, True


def serve(spark: SparkSession, port: int = 0) -> tuple[str, int, str]:
    """Where turns are to be had: host, port and a key, once for a context.  ``port`` may be fixed where only
    some are open between executors and the driver."""
    context = spark.sparkContext
    held = getattr(context, "_quirespark_turns", None)
    if held is None:
        import secrets

        host = context.getConf().get("spark.driver.host") or socket.gethostname()
        server = _Server((context.getConf().get("spark.driver.bindAddress") or host, port), _Handler)
        server.turns, server.key = Turns(), secrets.token_hex(16)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        held = context._quirespark_turns = (host, server.server_address[1], server.key)
    return held


class Queue:
    """A worker's line to where turns are handed out."""

    def __init__(self, at: tuple[str, int, str]):
        self.key = at[2]
        self.file = socket.create_connection(at[:2], timeout=60).makefile("rw")

    def wait(self, address: str, delay: float) -> None:
        """Return when it is this worker's turn to ask at ``address``."""
        if delay > 0:
            self.file.write(json.dumps({"address": address, "delay": delay, "key": self.key}) + "\n")
            self.file.flush()
            time.sleep(max(0.0, float(self.file.readline())))
