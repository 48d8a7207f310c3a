"""The export of a job with its verification report, each with its SQL."""

from __future__ import annotations

from drawlake.operators import rules as U
from drawlake.plans.calls import verify_checks
from drawlake.plans.registry import REGISTRY, query
from drawlake.plans.screens import _SIGNS_SQL, _signs
from drawlake.plans.text import _ROOM_NAMES, _rooms
from drawlake.session import scratch
from drawlake.sources import export as E
from drawlake.sources import files as S

_CHECKS = REGISTRY[verify_checks.__name__].sql


def _exported(spark, root):
    """All four sheets of the signs and rooms, written as one job."""
    folder = scratch(spark, "export")
    E.write_job(S.export_sheets(_signs(spark, root)) | {"verification": E.verification_report(U.assign(_rooms(spark, root)))}, folder)
    return folder


@query(
    "A15 A17",
    f"""WITH c AS ({_CHECKS}), m AS (SELECT p_partkey AS k, p_size AS s, {list(_ROOM_NAMES)}[(p_partkey % {len(_ROOM_NAMES)})::INT + 1] AS n FROM part),
        q AS (SELECT k || ' ' || n || ' [Level ' || (s % 4) || ']: ' || CASE n WHEN 'CHAPEL' THEN concat_ws('; ', CASE WHEN s % 3 = 0 THEN 'R3: assembly doors by door count 2' ELSE 'R3: assembly doors assumed 1, door count unknown' END,
                CASE WHEN s <= 25 THEN 'R9: two exits assumed, load unknown; R10: capacity to be verified, load unknown' END) ELSE 'R7/R8: no plaque entry, type unknown' END AS note FROM m WHERE n = 'WOMEN RESTROOM' OR n = 'CHAPEL' AND (s % 3 > 0 OR s <= 25)),
        r AS (SELECT CASE WHEN passed THEN 'pass' ELSE severity END AS kind, check_id AS check, CASE WHEN passed THEN '✓' WHEN severity = 'error' THEN '✗' ELSE '⚠' END AS status,
                CASE WHEN passed THEN 'Passed' ELSE check_id || ': found ' || found || ', expected ' || expected END AS detail FROM c UNION ALL SELECT 'question', 'Question', '?', note FROM q),
        n AS (SELECT count(*) FILTER (kind = 'error') AS e, count(*) FILTER (kind = 'warning') AS w, count(*) FILTER (kind = 'question') AS q FROM r)
        SELECT * FROM r UNION ALL SELECT 'overall', 'Overall Result', CASE WHEN e = 0 THEN '✓' ELSE '✗' END, CASE WHEN e = 0 THEN 'All checks passed' ELSE e || ' error(s), ' || w || ' warning(s), ' || q || ' question(s) for review' END FROM n""",
)
def exported_report(spark, root):
    """The verification report as it was exported with the sheets."""
    return E.read_sheet(spark, _exported(spark, root), "verification", "kind string, check string, status string, detail string")


@query("A15 A18", f"WITH {_SIGNS_SQL} SELECT sign_id, page_number, sign_identifier, sign_type, location, quantity::INT AS quantity FROM s WHERE NOT coalesce(hidden, false)")
def exported_rows(spark, root):
    """The visible signs, from the export's JSON."""
    return E.read_sheet(spark, _exported(spark, root), "rows", "sign_id long, page_number int, sign_identifier string, sign_type string, location string, quantity int")
