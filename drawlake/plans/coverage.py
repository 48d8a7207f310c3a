"""Which library functions a query runs, and the coverage table that follows: ``python -m drawlake.plans.coverage FOLDER`` rewrites COVERAGE.md."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
TABLE = ROOT / "COVERAGE.md"
_ROW = re.compile(r"^\| (\S+) \| (.*?) \| (.*?) \|$")


def traced(run: Callable) -> tuple[object, set[str]]:
    """What ``run`` returns and the library functions it called, as module.function."""
    seen: set[str] = set()
    kinds = tuple(str(ROOT / "drawlake" / d) for d in ("operators", "functions", "sources", "streaming"))

    def note(frame, event, arg):
        if event == "call" and frame.f_code.co_filename.startswith(kinds):
            seen.add(f"{Path(frame.f_code.co_filename).stem}.{frame.f_code.co_name}")

    before = sys.getprofile()
    sys.setprofile(note)
    try:
        return run(), seen
    finally:
        sys.setprofile(before)


def rows() -> list[tuple[str, list[str], list[str]]]:
    """``(id, functions, queries)`` of the table; no functions for built-in forms."""
    found = [m.groups() for m in map(_ROW.match, TABLE.read_text().splitlines()) if m]
    names = lambda s: re.findall(r"`([^`]+)`", s)
    return [(i, [f for f in names(fs) if re.fullmatch(r"[a-z_]+\.[A-Za-z_]+", f)], names(qs)) for i, fs, qs in found if i != "Id"]


#: Functions that run in the tasks, out of a trace's sight, and those that unit tests show and no query of their row does.
UNSEEN = {"models.parsed_rows", "models.complete_objects", "models.recovered_callouts", "knowledge.chunk_spans", "files.field_columns"}
TESTS_ONLY = {"rules.page_audit", "rules.zero_sign_summary", "aggregates.upper_median", "rules.decision_log", "views.page_with_next", "rooms.in_set", "text.first_listed", "labels.zone_anchors", "rules.with_plaques"}


def false_claims(calls: dict[str, set[str]], claims: dict[str, tuple[str, ...]]) -> list[str]:
    """Claims whose query calls none of the operator's functions, and functions of a row of the table that none of its queries calls."""
    functions = {i: set(fs) for i, fs, _ in rows()}
    wrong = [f"table: {i} by {q}" for i, fs, qs in rows() for q in qs if fs and q in calls and not calls[q] & set(fs)]
    wrong += [f"table: {i} without {f}" for i, fs, qs in rows() for f in fs if f not in UNSEEN | TESTS_ONLY and qs and all(q in calls for q in qs) and not any(f in calls[q] for q in qs)]
    return wrong + [f"registry: {i} by {q}" for q, ids in claims.items() for i in ids if functions.get(i) and q in calls and not calls[q] & functions[i]]


def main() -> None:
    from drawlake.plans import REGISTRY
    from drawlake.session import session

    spark = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    calls = {n: traced(lambda q=q: q.run(spark, sys.argv[1]))[1] for n, q in REGISTRY.items()}
    functions = {i: fs for i, fs, _ in rows()}

    def line(text: str) -> str:
        m = _ROW.match(text)
        if not m or m[1] not in functions:
            return text
        fs = functions[m[1]]
        run = sorted(q for q in calls if (calls[q] & set(fs) if fs else m[1] in REGISTRY[q].operators))
        claimed = [q for q in run if m[1] in REGISTRY[q].operators]
        return f"| {m[1]} | {m[2]} | {', '.join(f'`{q}`' for q in (claimed or run)[:6])} |"

    TABLE.write_text("\n".join(map(line, TABLE.read_text().splitlines())) + "\n")
    print("\n".join(false_claims(calls, {n: q.operators for n, q in REGISTRY.items()})))
    spark.stop()


if __name__ == "__main__":
    main()
