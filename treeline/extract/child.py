"""The process that parses for :mod:`treeline.extract.watched`: one text after the other, until its input ends.

Messages are JSON behind their length in eight bytes.
"""

from __future__ import annotations

import json
import resource
import struct
import sys

from treeline.extract import javascript, python


def main() -> None:
    most = int(sys.argv[1]) << 20
    resource.setrlimit(resource.RLIMIT_AS, (most, most))
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
    source, sink = sys.stdin.buffer, sys.stdout.buffer
    while head := source.read(8):
        asked = json.loads(source.read(struct.unpack("<q", head)[0]))
        try:
            got = (python if asked["language"] == "python" else javascript).extract(asked["text"])
            told = json.dumps({"got": got}).encode()
        except MemoryError:
            told = b'{"fatal": "ran out of memory"}'
        except Exception as e:
            told = json.dumps({"failed": " ".join(str(e).split())[:200] or type(e).__name__}).encode()
        sink.write(struct.pack("<q", len(told)) + told)
        sink.flush()


if __name__ == "__main__":
    main()
