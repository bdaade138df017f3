"""python -m quern compile|schema|validate|explain|query MODEL [REQUEST]: a model file, and a request as JSON or a file of it."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("what", choices=["compile", "schema", "validate", "explain", "query"])
    parser.add_argument("model")
    parser.add_argument("request", nargs="?")
    parser.add_argument("--rows", type=int, default=20, help="rows that query shows")
    a = parser.parse_args(args)
    if a.what == "compile":
        from .manifest import compile_model

        print(compile_model(a.model).to_json())
        return 0
    from pyspark.sql import SparkSession

    from .engine import Engine

    engine = Engine(SparkSession.builder.getOrCreate(), a.model)
    if a.what == "schema":
        print(json.dumps(engine.schema(), indent=1))
        return 0
    if a.request is None:
        parser.error("a request is wanted")
    request = json.loads(Path(a.request).read_text() if not a.request.lstrip().startswith("{") else a.request)
    if a.what == "validate":
        wrong = engine.validate(request)
        print("\n".join(wrong) or "ok")
        return int(bool(wrong))
    if a.what == "explain":
        print(engine.explain(request))
    else:
        engine.query(request).show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
