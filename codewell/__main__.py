"""Interactive text search: ``python -m codewell METADATA.parquet``; one query per line, ``exit`` ends."""

from __future__ import annotations

import sys
from collections.abc import Iterable


def loop(engine, lines: Iterable[str], top_k: int = 5) -> Iterable[str]:
    """Answers to the lines until ``exit``; blank lines are skipped."""
    for line in lines:
        query = line.strip()
        if query.lower() == "exit":
            return
        if query:
            hits = engine.search(query, top_k)
            yield from (f"{i}. {h.score:.4f}  {h.metadata['title']} - {h.metadata['artist']}" for i, h in enumerate(hits, 1))
            if not hits:
                yield "no result"


def main(path: str) -> None:
    from codewell.api import TextSearch
    from codewell.runtime import session

    engine = TextSearch(session().read.parquet(path))
    for answer in loop(engine, sys.stdin):
        print(answer)


if __name__ == "__main__":
    main(sys.argv[1])
