"""Parsing in a watched process: what ends it costs one row, and isn't tried again."""

import sys

from treeline.extract import api, watched

#: A child that dies of some texts, in different ways, and parses the others.
CHILD = """
import os, sys, time, json, struct
from treeline.extract import child, javascript, python
parse = python.extract
def extract(text):
    if "KILL" in text: os.kill(os.getpid(), 9)
    if "EXIT" in text: os._exit(3)
    if "HANG" in text: time.sleep(100)
    if "EAT" in text: bytearray(1 << 40)
    if "RAISE" in text: raise ValueError("two\\n lines")
    return parse(text)
python.extract = extract
child.main()
"""
COMMAND = [sys.executable, "-c", CHILD, "1024"]
ROWS = [(f"{n}.py", "python", n, f"def f_{n}():\n    return 1\n# {n}\n") for n in ("a", "KILL", "b", "EXIT", "HANG", "EAT", "RAISE", "c")]
ROWS += [("again.py", "python", "KILL", ROWS[1][3]), ("null.py", "python", "null", None), ("d.js", "javascript", "d", "function g() {}\n")]


def test_what_kills_the_parser_costs_one_row(spark):
    files = spark.createDataFrame(ROWS, "path string, language string, sha string, text string").coalesce(1)
    none = spark.createDataFrame([], "language string, sha string, reason string")
    extracts, memo = watched.remembered(files, none, seconds=6.0, command=COMMAND)
    got = {r["path"]: r for r in extracts.collect()}
    assert len(got) == len(ROWS)
    assert {p: r["reason"] for p, r in got.items() if r["reason"]} == {
        "KILL.py": "killed by signal 9", "again.py": "killed by signal 9", "EXIT.py": "ended its process", "HANG.py": "took more than 6 seconds", "EAT.py": "ran out of memory", "RAISE.py": "two lines",
    }
    assert [s["name"] for p in ("a.py", "b.py", "c.py", "d.js") for s in got[p]["symbols"]] == ["f_a", "f_b", "f_c", "g"]
    remembered = sorted(map(tuple, memo.collect()))
    assert [m[1] for m in remembered] == ["EAT", "EXIT", "HANG", "KILL"]
    # next time nothing of these is parsed: a child that would die of them isn't asked
    again, memo = watched.remembered(files, spark.createDataFrame(remembered, "language string, sha string, reason string"), seconds=6.0, command=COMMAND)
    assert {r["path"]: r["reason"] for r in again.collect()} == {p: r["reason"] for p, r in got.items()}
    assert sorted(map(tuple, memo.collect())) == remembered


def test_equal_to_parsing_in_the_task(spark):
    text = "import os\n\n\nclass A:\n    'Says what.'\n    def m(self):\n        return 1\n" + "\n".join(f"def f{i}(): pass" for i in range(4000))
    files = spark.createDataFrame([("a.py", "python", text), ("b.ts", "typescript", "export class B { m() {} }\nimport x from './y'\n"), ("c.py", "python", "def (")], "path string, language string, text string")
    assert sorted(map(str, watched.watched(files).drop("fatal").collect())) == sorted(map(str, api.extract(files).collect()))
