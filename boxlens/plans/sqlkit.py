"""DuckDB SQL fragments for the oracle side of the registered queries."""

from __future__ import annotations


def iou_sql(a: str, b: str) -> str:
    """E1 in SQL on x/y/w/h columns of aliases ``a`` and ``b`` (corner form, as in Spark)."""
    inter = (f"(GREATEST(0.0, LEAST({a}.bbox_x+{a}.bbox_w, {b}.bbox_x+{b}.bbox_w) - GREATEST({a}.bbox_x, {b}.bbox_x))"
             f" * GREATEST(0.0, LEAST({a}.bbox_y+{a}.bbox_h, {b}.bbox_y+{b}.bbox_h) - GREATEST({a}.bbox_y, {b}.bbox_y)))")
    area_a = f"(({a}.bbox_x+{a}.bbox_w)-{a}.bbox_x)*(({a}.bbox_y+{a}.bbox_h)-{a}.bbox_y)"
    area_b = f"(({b}.bbox_x+{b}.bbox_w)-{b}.bbox_x)*(({b}.bbox_y+{b}.bbox_h)-{b}.bbox_y)"
    union = f"({area_a} + {area_b} - {inter})"
    return f"CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0 END"


def argmax_ctes(source: str, iou: float, conf: float | None, same_class: bool = False) -> list[str]:
    """CTEs P, G, pairs, best, claim implementing W1 + W2 (the sequential loop's result)."""
    conf_cut = f" AND COALESCE(confidence, 1.0) >= {conf}" if conf is not None else ""
    cls = " AND p.category_name = g.category_name" if same_class else ""
    return [
        f"P AS (SELECT * FROM annotations WHERE dataset_id='ds1' AND source='{source}'{conf_cut})",
        "G AS (SELECT * FROM annotations WHERE dataset_id='ds1' AND source='ground_truth')",
        f"""pairs AS (SELECT p.sample_id, p.id p_id, p.category_name p_cat, COALESCE(p.confidence, 1.0) conf,
                       g.id g_id, g.category_name g_cat, {iou_sql('p', 'g')} iou
                FROM P p JOIN G g ON p.dataset_id = g.dataset_id AND p.sample_id = g.sample_id{cls})""",
        """best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_id ORDER BY iou DESC, g_id) rn
                               FROM pairs WHERE iou > 0) WHERE rn = 1)""",
        f"""claim AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY g_id ORDER BY conf DESC, p_id) cr
                               FROM best WHERE iou >= {iou}) WHERE cr = 1)""",
    ]


def error_label_ctes(source: str = "run_a", iou: float = 0.5, conf: float = 0.25) -> list[str]:
    """CTE ``labels`` = E9 per box."""
    return argmax_ctes(source, iou, conf) + [
        """labels AS (
            SELECT P.sample_id, P.id annotation_id,
                   CASE WHEN c.p_id IS NULL THEN 'hard_fp' WHEN c.p_cat = c.g_cat THEN 'tp' ELSE 'label_error' END error_type,
                   P.category_name, P.confidence, c.g_id matched_id, c.iou
            FROM P LEFT JOIN claim c ON c.p_id = P.id
            UNION ALL
            SELECT G.sample_id, G.id, 'false_negative', G.category_name, NULL, NULL, NULL
            FROM G WHERE G.id NOT IN (SELECT g_id FROM claim))"""]
