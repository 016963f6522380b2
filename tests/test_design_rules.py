"""Design rules of the library code, checked statically."""

import pathlib
import re

LIB = pathlib.Path(__file__).resolve().parent.parent / "lumenlog"
FORBIDDEN = {
    r"\bcrossJoin\b": "no cross joins",
    r"\blocalCheckpoint\b": "no local checkpoints (cut lineage in the shared checkpoint folder)",
    r"\b(F\.udf|pandas_udf|@udf)\b": "no Python UDFs: built-in expressions only",
    r"\bbroadcast\(": "no unconditional broadcast hints: Spark/AQE size checks decide",
    r"\.toPandas\(": "nothing whole through the driver",
}
# the only driver-side collect: the (small, user-given) note-file mapping, to list the paths to read
ALLOWED_COLLECT = {"operators/notes.py"}


def _sources():
    for p in sorted(LIB.rglob("*.py")):
        if "llm" in p.relative_to(LIB).parts:  # training-data operators: their own rules
            continue
        yield p.relative_to(LIB).as_posix(), p.read_text(encoding="utf-8")


def test_forbidden_constructs():
    bad = [(name, why) for name, src in _sources() for pat, why in FORBIDDEN.items() if re.search(pat, src)]
    assert bad == []


def test_collect_only_where_documented():
    bad = [name for name, src in _sources() if ".collect()" in src and name not in ALLOWED_COLLECT]
    assert bad == []
