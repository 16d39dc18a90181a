"""The derived views as SQL for the side-by-side check, in dependency order."""

from __future__ import annotations

VIEW_SQL: dict[str, str] = {
    "items": "SELECT CAST(doc_id AS VARCHAR) AS stem, n_chars AS length, sha256(text) AS sha256, source, doc_id FROM documents",
    "listing": "SELECT stem AS path, sha256, length AS size_bytes FROM items",
    "copied": """SELECT stem AS path,
        CASE WHEN source = 'src5' THEN reverse(sha256) WHEN source IN ('src1', 'src9') THEN upper(sha256) ELSE sha256 END AS sha256,
        length AS size_bytes FROM items WHERE source <> 'src3'""",
    "files": """SELECT (['final_clean', 'logs/batch_summaries', 'temp_processed'])[doc_id % 3 + 1] AS root,
        (['orig_', 'thumb_', 'test_', 'perf_', '', ''])[doc_id % 6 + 1] || CAST(doc_id AS VARCHAR)
          || (['.jpg', '.PNG', '.mp4', '.json', '.tiff'])[doc_id % 5 + 1] AS rel_path,
        FALSE AS is_dir, n_chars AS size_bytes, source FROM documents""",
    "qa": """SELECT d.doc_id, d.source,
        CASE WHEN toxic = 1 THEN 0.95 WHEN toxic = 0 THEN 0.10 END AS max_score, toxic AS count,
        CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.6 END AS ssim
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "judged": """SELECT doc_id, source, max_score, count, ssim,
        coalesce(max_score >= 0.85 AND count > 0, FALSE) AS detection_fail,
        coalesce(ssim < 0.75, FALSE) AS integrity_fail FROM qa""",
    "decided": """SELECT *, CASE WHEN detection_fail OR integrity_fail THEN 'fail' ELSE 'pass' END AS final_decision,
        CASE WHEN detection_fail OR integrity_fail THEN concat_ws(' | ',
          CASE WHEN detection_fail THEN 'detection_verification:readable_text_likely_remaining' END,
          CASE WHEN integrity_fail THEN 'identity_integrity:artifact_or_identity_risk' END) END AS failure_reason
        FROM judged""",
    "routed": """SELECT *, CASE WHEN final_decision = 'pass' THEN prev ELSE prev + 1 END AS retry_count,
        CASE WHEN final_decision = 'pass' THEN 'final_clean' WHEN prev + 1 >= 3 THEN 'manual_review'
             ELSE 'quarantine' END AS route
        FROM (SELECT *, length(source) - 4 AS prev FROM decided)""",
    "pairs": """SELECT l.vec_id, l.embedding AS a, r.embedding AS b FROM embeddings l JOIN embeddings r
        ON r.vec_id = CASE WHEN l.vec_id % 10 = 0 THEN l.vec_id ELSE l.vec_id + 1 END""",
    "distances": """SELECT vec_id, 1.0 - list_sum([CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE) for z in list_zip(a, b)])
        / ((sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in a])) + 1e-8)
         * (sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in b])) + 1e-8)) AS distance
        FROM pairs""",
    "detections": """SELECT CAST(l_orderkey AS VARCHAR) AS stem, l_returnflag AS text, 0.80 + l_discount AS score,
        l_linenumber FROM lineitem""",
    "outcomes": """SELECT *, CASE WHEN outcome = 'pass' THEN 'final_clean' ELSE outcome END AS route FROM (
        SELECT event_id, ts, user_id, value, event_id // 500 AS batch_index,
        'run-' || CAST((event_id // 500) % 2 AS VARCHAR) AS run_id,
        CASE event_type WHEN 'signup' THEN 'quarantine' WHEN 'error' THEN 'manual_review' ELSE 'pass' END AS outcome
        FROM events)""",
    "batches": """SELECT run_id, batch_index, count(*) AS images,
        sum(value) / 100 * CASE WHEN batch_index % 7 = 0 THEN 3.0 ELSE 1.0 END AS elapsed_sec,
        count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'quarantine') AS quarantine,
        count(*) FILTER (outcome = 'manual_review') AS manual_review
        FROM outcomes GROUP BY run_id, batch_index""",
    "timed": """SELECT *, elapsed_sec / images AS sec_per_image FROM batches""",
    "attempts": """SELECT CAST(user_id AS VARCHAR) AS stem, ts, event_id,
        CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS decision,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events""",
    "hard_attempts": """SELECT CAST(user_id AS VARCHAR) AS stem, ts, event_id,
        CASE WHEN event_type = 'purchase' THEN 'pass' ELSE 'fail' END AS decision,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events""",
    "nth_fail": """SELECT *, sum(CASE WHEN decision = 'fail' THEN 1 ELSE 0 END) OVER w AS fails,
        sum(CASE WHEN decision = 'pass' THEN 1 ELSE 0 END) OVER w AS passes
        FROM hard_attempts WINDOW w AS (PARTITION BY stem ORDER BY attempt ROWS UNBOUNDED PRECEDING)""",
    "settling": """SELECT stem, attempt, decision, fails,
        CASE WHEN decision = 'pass' THEN 'final_clean' WHEN fails >= 3 THEN 'manual_review' ELSE 'quarantine' END AS route
        FROM nth_fail WHERE (decision = 'pass' AND passes = 1 AND fails < 3)
          OR (decision = 'fail' AND passes = 0 AND fails <= 3)""",
    "locks": """SELECT user_id * 100000000 + CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS batch_index,
        CAST(user_id AS VARCHAR) AS stem, date_trunc('second', min(ts)) AS started,
        count(*) FILTER (event_type = 'purchase') > 0 AS done
        FROM events GROUP BY user_id, strftime(ts, '%Y%m%d')""",
    "listed": """SELECT DISTINCT CAST(CASE WHEN l_orderkey % 50 = 0 THEN l_orderkey + 1000000 ELSE l_orderkey END AS VARCHAR) AS path
        FROM lineitem""",
    "expected": "SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders",
    "candidates": """SELECT CAST(c_nationkey AS VARCHAR) AS stem, c_custkey % 2 AS priority, c_name AS path, c_custkey
        FROM customer""",
    "queued": """SELECT CAST(o_custkey AS VARCHAR) AS stem, 'raw/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS path,
        0 AS retry_count, 1 AS priority FROM orders WHERE o_orderstatus <> 'P'
        UNION ALL
        SELECT CAST(o_custkey AS VARCHAR), 'quarantine/' || CAST(o_orderkey AS VARCHAR) || '.jpg',
        CAST(left(o_orderpriority, 1) AS INTEGER) - 1, 0 FROM orders
        WHERE o_orderstatus = 'P' AND CAST(left(o_orderpriority, 1) AS INTEGER) - 1 < 3""",
    "excluded": """SELECT CAST(c_custkey AS VARCHAR) AS stem FROM customer
        WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0
        UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_totalprice > 400000""",
    "pending": """SELECT stem, path, retry_count, priority FROM (
        SELECT *, row_number() OVER (PARTITION BY stem ORDER BY priority, path) AS n FROM queued) q
        WHERE n = 1 AND stem NOT IN (SELECT stem FROM excluded)""",
}

_DEPENDS = {
    "listing": ("items",), "copied": ("items",), "judged": ("qa",), "decided": ("judged",), "routed": ("decided",),
    "distances": ("pairs",), "batches": ("outcomes",), "timed": ("batches",), "nth_fail": ("hard_attempts",),
    "settling": ("nth_fail",), "pending": ("queued", "excluded"),
}


def _closure(names: set[str]) -> set[str]:
    out = set(names)
    for name in names:
        out |= _closure(set(_DEPENDS.get(name, ())))
    return out


def with_views(views: str, body: str) -> str:
    """``body`` preceded by the views it names and those they need. A body may start with ``,`` and add its own."""
    wanted = _closure(set(views.split()))
    parts = [f"{name} AS ({sql})" for name, sql in VIEW_SQL.items() if name in wanted]
    return f"WITH {', '.join(parts)}{' ' if not body.startswith(',') else ''}{body}" if parts else body
