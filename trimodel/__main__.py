"""python -m trimodel [FOLDER]: statements from standard input, each block ended by an empty line.

Rows are shown as a table of at most 20; other statements say what they did. FOLDER's Parquet files are tables."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterable

from trimodel.errors import TrimodelError
from trimodel.session import Session


def blocks(lines: Iterable[str]) -> Iterable[str]:
    held: list[str] = []
    for line in lines:
        if line.strip():
            held.append(line.rstrip("\n"))
        elif held:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


def run(session: Session, lines: Iterable[str], say: Callable[[str], object] = print) -> None:
    for text in blocks(lines):
        if text.strip() in ("quit", "exit"):
            return
        try:
            for o in session.execute(text):
                if o.rows is not None:
                    say(o.rows._show_string(20, True, False).rstrip("\n"))
                else:
                    say(o.kind if o.count is None else f"{o.count} {o.kind}")
        except TrimodelError as e:
            say(f"{type(e).__name__}: {e}")


def main() -> None:
    from pyspark.sql import SparkSession

    session = Session(SparkSession.builder.appName("trimodel").getOrCreate())
    if len(sys.argv) > 1:
        session.read_folder(sys.argv[1], tuple(sorted(f[:-8] for f in os.listdir(sys.argv[1]) if f.endswith(".parquet"))))
    run(session, sys.stdin)


if __name__ == "__main__":
    main()
