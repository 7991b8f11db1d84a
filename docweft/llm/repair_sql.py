"""The SQL form of op13: a fold over the rows of a conversation with the least (cost, audit) of four states.

A value is the cost in nine digits with the audit behind it, so that the least text is the least value.
"""

from __future__ import annotations


def _least(ways: list[tuple[str, str, str, str]]) -> str:
    """Of (state before, cost, letters, condition)."""
    one = "CASE WHEN {3} THEN lpad(CAST(CAST(st.{0}[1:9] AS BIGINT) + {1} AS VARCHAR), 9, '0') || st.{0}[10:] || '{2}' END"
    return "least(" + ", ".join(one.format(*w) for w in ways) + ")"


def _inserted(ways: list) -> list:
    return [(x, f"{cost} + 5", letters + "I", when) for x, cost, letters, when in ways]


def _step() -> str:
    taken = lambda x, role: [(x, "1 + r.more", "R", "NOT r.wrong"), (x, "r.more", "K", f"NOT r.wrong AND r.ini = '{role}'")]
    gone = {x: [(x, "2", "D", "true")] for x in "zsua"}
    z, s = gone["z"], gone["s"] + [("z", "r.more", "K", "NOT r.wrong AND r.ini = 's'")]
    u, a = gone["u"] + [w for x in "zsa" for w in taken(x, "u")], gone["a"] + taken("u", "a")
    u = u + _inserted(z + s + a)
    a = a + _inserted(u)
    fields = ", ".join(f"'{name}': {_least(ways)}" for name, ways in zip("zsua", (z, s, u, a), strict=True))
    return f"{{{fields}, 'ini': '', 'wrong': false, 'more': 0}}"


REPAIR = rf"""
    WITH RECURSIVE z(b, k, v) AS (
        SELECT range, 0, range FROM range(256)
        UNION ALL
        SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM z WHERE k < 8
    ), tab AS (
        SELECT list(v ORDER BY b) AS crc FROM z WHERE k = 8
    ), r AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
    ), f AS (
        SELECT r.*, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ord(key[i]) AS BIGINT)), lambda a, x: xor(a >> 8, crc[xor(a, x) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fault FROM r, tab
    ), d AS (
        SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM f
    ), w AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d
    ), m AS (
        SELECT conv_id, turn, role, text, again, left(role, 1) AS ini, row_number() OVER o AS n, lag(left(role, 1)) OVER o AS before,
            NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
            NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
        FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)
    ), g AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
            count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
            list({{'z': '', 's': '', 'u': '', 'a': '', 'ini': ini, 'wrong': blank OR again, 'more': CASE WHEN cut THEN 5 ELSE 0 END}} ORDER BY n) AS rows
        FROM m GROUP BY conv_id
    ), e AS (
        SELECT g.*, list_reduce(rows, lambda st, r: {_step()}, {{'z': '000000000', 's': CAST(NULL AS VARCHAR), 'u': '000000005I', 'a': '000000010II', 'ini': '', 'wrong': false, 'more': 0}}) AS st FROM g
    ), h AS (
        SELECT * EXCLUDE (rows, st), CAST(least(st.z, st.a)[1:9] AS BIGINT) AS cost, least(st.z, st.a)[10:] AS audit FROM e
    ), l AS (
        SELECT conv_id, unnest(range(1, length(audit) + 1)) AS i, audit FROM h
    ), p AS (
        SELECT conv_id, i, audit[i] AS edit, length(replace(audit[1:i], 'I', '')) AS n, length(replace(audit[1:i], 'D', '')) - 1 AS place FROM l
    ), q AS (
        SELECT p.*, m.role, m.text, max(CASE WHEN place = 0 AND edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS first
        FROM p LEFT JOIN m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.n = m.n
    ), t AS (
        SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - first) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS repaired
        FROM q WHERE edit <> 'D' GROUP BY conv_id
    )
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN h ON c.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id"""
